import json

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.documents import process_batch, process_documents
from palimpsest.sources import intake, sinks


def test_requests(spark):
    body = json.dumps({"images": [{"image": "data:image/png;base64,aGk=", "filename": "a b.png"}, {"image": "aGk="}, {"image": "?"}, {}],
                       "options": {"pii_confidence": 0.9, "pii_engines": ["spacy"]}})
    df = spark.createDataFrame([(body,), ("{}",), ("not json",)], "body string")
    rows = intake.with_options(intake.decode_images(intake.parse_requests(df))).orderBy("batch_pos").collect()
    assert [(r.document_id, r.content and bytes(r.content), r.error_message) for r in rows] == [
        ("a b.png", b"hi", None), ("batch_doc_1", b"hi", None),
        ("batch_doc_2", None, "Invalid base64 image data"), ("batch_doc_3", b"", "Invalid base64 image data"),
    ]
    assert rows[0].opt_pii_confidence == 0.9 and rows[0].opt_pii_engines == ["spacy"]
    assert rows[0].opt_ocr_confidence == 0.7 and rows[0].opt_preserve_format is True


def test_batch_ids(spark):
    df = spark.createDataFrame([(["a", "b"], None), (["c"], "own")], "texts array<string>, name string")
    rows = intake.batch_documents(df, "texts", "name").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("batch_doc_0", "a"), ("batch_doc_1", "b"), ("own", "c")]


def test_validation(spark):
    df = spark.createDataFrame(
        [(1, "x", 10, 0, "image/png", "a.PNG"), (2, "x" * 1_000_001, 10, 0, "image/png", "a.png"),
         (3, "x", 52_428_801, 0, "image/png", "a.png"), (4, "x", 10, 20, "image/png", "a.png"),
         (5, "x", 10, 0, "text/plain", "a.png"), (6, "x", 10, 0, "image/png", "a.gif"), (7, "x", 52_428_800, 19, "image/bmp", "b.bmp")],
        "doc_id int, text string, size_bytes long, batch_pos int, mime string, filename string",
    )
    checked = intake.validate(df)
    assert [r.doc_id for r in intake.accepted(checked).orderBy("doc_id").collect()] == [1, 7]
    assert [r.reject_reason for r in intake.rejected(checked).orderBy("doc_id").collect()] == [
        "text too long", "file too large", "batch too large", "type not allowed", "extension not allowed"]


def test_readers_and_catalogue(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("line 1\nline 2")
    assert tuple(intake.read_documents(spark, str(tmp_path / "t"), "text").first()) == ("one.txt", "line 1\nline 2")
    spark.createDataFrame([(1, "ORG", 0, 1)], "doc_id long, raw_label string, start int, end_pos int").write.json(str(tmp_path / "ner"))
    assert intake.read_engine_output(spark, "spacy", str(tmp_path / "ner"), "json").first().end_pos == 1
    labels = spark.createDataFrame([("PERSON",), ("NEW",), ("NEW",), ("spacy",)], "label string")
    got = {r.label: r.entities for r in intake.unknown_labels(labels, intake.entity_catalogue(spark)).collect()}
    assert got == {"NEW": 2, "spacy": 1}


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.createDataFrame(
        [(1, "badge B-445566", None, 1.5, 3), (2, None, "broken file", 0.5, 2), (3, "nothing", None, 1.0, 1)],
        "doc_id long, text string, load_error string, total_time double, batch_pos int",
    )
    boxes = spark.createDataFrame(
        [(1, 0, 0, 0.9, 0, 0, 5, 5), (1, 1, 99, 0.95, 0, 0, 9, 9), (1, 2, 0, 0.5, 0, 0, 5, 5)],
        "doc_id long, seq int, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int",
    )
    return process_documents(docs, boxes=boxes)


def test_document_job(spark, run):
    rows = {r.doc_id: r for r in run.documents.collect()}
    assert rows[1].entities_found == 1 and rows[1].logos_found == 2 and rows[1].success
    assert rows[2].anonymized_text is None and rows[2].error_message == "broken file" and not rows[2].success
    assert rows[3].anonymized_text == "nothing" and rows[3].logo_confidence == 0.0
    assert run.entities().count() == 1 and run.mapping().count() == 1
    assert [r.doc_id for r in run.audit(F.current_timestamp()).orderBy("doc_id").collect()] == [1, 3]


def test_sinks(spark, run, tmp_path):
    path = str(tmp_path / "batch")
    sinks.save_batch_results(run.documents, path)
    summary = spark.read.json(f"{path}/batch_summary").first()
    assert (summary.total_documents, summary.successful, summary.failed) == (3, 2, 1)
    assert summary.average_processing_time == 1.25 and summary.total_logos_found == 2
    assert spark.read.json(f"{path}/errors").first().error == "broken file"
    assert spark.read.parquet(f"{path}/anonymized_text").count() == 2
    results = {r.doc_id: r for r in spark.read.json(f"{path}/processing_results").collect()}
    assert results[1].extracted_text_length == 14 and results[1].anonymization_mapping[0].original == "B-445566"
    done = spark.read.parquet(f"{path}/processed")
    assert [r.batch_pos for r in sinks.in_input_order(done).collect()] == [1, 2, 3]
    body = json.loads(sinks.responses(done, run.logos).where("doc_id = 1").first().response)
    assert [logo["class_name"] for logo in body["logos"]] == ["unknown_99", "microsoft"]
    assert body["entities"][0]["label"] == "BADGE_NUMBER" and body["success"]
    report = json.loads(sinks.reports(done).where("doc_id = 1").first().report)
    assert report["entities_found"] == 1 and report["processing_time"] == 1.5
    sinks.export_detections(run.logos, str(tmp_path / "logos"))
    assert spark.read.json(str(tmp_path / "logos")).count() == 2
    sinks.export_mapping(run.mapping().select("original", "anonymized"), str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map" / "summary")).first().total_mappings == 1
    page = spark.createDataFrame([("a\nb", 0.5)], "full_text string, average_confidence double")
    sinks.export_ocr(page, str(tmp_path / "ocr"))
    assert spark.read.json(str(tmp_path / "ocr")).first().full_text == "a\nb"
    sinks.export_ocr(page, str(tmp_path / "txt"), "TXT")
    with pytest.raises(ValueError):
        sinks.export_ocr(page, str(tmp_path / "x"), "xml")


def test_logos_of_one_document_are_one_row(spark):
    boxes = spark.createDataFrame(
        [(1, i, "c", (i % 7) / 10, 0, 0, i, i, 5) for i in range(35)],
        "doc_id long, seq int, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int, area long",
    )
    (row,) = sinks.logo_rows(boxes).collect()
    scores = [logo.confidence for logo in row.logos]
    assert len(scores) == 35 and scores == sorted(scores, reverse=True)


def test_limits_are_arguments(spark):
    docs = spark.createDataFrame([("abc", 0), ("a", 3)], "text string, batch_pos int")
    assert [r.reject_reason for r in intake.validate(docs).collect()] == [None, None]
    strict = intake.validate(docs, max_text_chars=2, max_batch=3).collect()
    assert [r.reject_reason for r in strict] == ["text too long", "batch too large"]


def test_ids_of_several_batches_differ(spark):
    df = spark.createDataFrame([(7, ["a", "b"]), (8, ["c"])], "batch long, texts array<string>")
    rows = intake.batch_documents(df, "texts", batch_key="batch").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == ["batch_doc_7_0", "batch_doc_7_1", "batch_doc_8_0"]


def test_engine_tables_keep_their_words(spark, tmp_path):
    rows = spark.createDataFrame([(1, "PER", 0, 3, 0.9, "Ann", 4)], intake.SCHEMAS["transformers"])
    rows.write.parquet(str(tmp_path / "t"))
    assert intake.read_engine_output(spark, "transformers", str(tmp_path / "t")).first().word == "Ann"


def test_options_per_document(spark):
    docs = spark.createDataFrame(
        [(1, "EMP123456", (0.99, ["custom_patterns"], True)), (2, "EMP123456", (None, ["custom_patterns"], False)), (3, "EMP123456", None), (4, "EMP123456", (0.5, [], None))],
        "doc_id long, text string, o struct<pii_confidence:double,pii_engines:array<string>,preserve_format:boolean>",
    ).withColumn("options", F.expr(
        "named_struct('ocr_confidence', 0.7D, 'pii_confidence', o.pii_confidence, 'logo_confidence', 0.6D, 'pii_engines', o.pii_engines, "
        "'logo_removal_method', 'blur', 'preserve_format', o.preserve_format, 'realistic_replacements', true)"))
    rows = {r.doc_id: r for r in process_documents(docs).documents.collect()}
    assert rows[1].entities_found == 0 and rows[2].anonymized_text == "[EMPLOYEE_ID]"
    assert rows[3].entities_found == 1 and rows[3].anonymized_text != "[EMPLOYEE_ID]"
    assert rows[4].entities_found == 0


def test_batch_job_keeps_order_and_saves(spark, tmp_path):
    df = spark.createDataFrame([(["EMP123456", "none", "B-445566"],)], "texts array<string>")
    done = process_batch(df, path=str(tmp_path / "b"), engines=("custom_patterns",))
    assert [(r.doc_id, r.entities_found) for r in sinks.in_input_order(done).collect()] == [
        ("batch_doc_0", 1), ("batch_doc_1", 0), ("batch_doc_2", 1)]
    assert spark.read.json(str(tmp_path / "b" / "batch_summary")).first().average_processing_time == 0.0
    assert process_batch(df).count() == 3


def test_written_run(spark, run, tmp_path):
    stored = run.written(str(tmp_path / "run"))
    assert stored.entities().collect() == run.entities().collect()
    assert stored.logos.count() == 2 and stored.blocks is None and stored.regions is None
