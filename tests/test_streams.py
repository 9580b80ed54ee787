import datetime as dt
import time

from palimpsest.checks.documents import QUERIES
from palimpsest.plans.detection import detect
from palimpsest.operators.rewrite import anonymize
from palimpsest.streaming.streams import anonymized_stream, document_stream, run_available, running_metrics

COLUMNS = ["doc_id", "anonymized_text", "entities_processed"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"user {i} EMP{i:06d} at 10.0.0.{i % 256} and a{i}@b.org") for i in range(200)], "doc_id long, text string")
    docs.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=2)
    out = anonymized_stream(stream).select(*COLUMNS)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [" not in plan and "Join" not in plan
    query = run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len(query.recentProgress) > 1
    batch = anonymize(detect(docs, engines=("presidio", "custom_patterns"), threshold=0.8)).select(*COLUMNS)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    # Nothing new: a second start adds nothing.
    run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_late_runs_are_dropped(spark, tmp_path):
    schema = "ts timestamp, success boolean, total_time double"

    def hour(h, m=0):
        return dt.datetime(2024, 1, 1, h, m)

    batches = [
        [(hour(1), True, 1.0), (hour(1, 30), False, 9.0)],
        [(hour(9), True, 2.0)],
        [(hour(9, 5), True, 2.0)],
        [(hour(1, 10), True, 5.0), (hour(15), True, 3.0)],
        [(hour(20), True, 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = document_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    run_available(running_metrics(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = {r.window_start.hour: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows[1].total_processed, rows[1].successful, rows[1].average_time) == (2, 1, 1.0)
    assert rows[9].total_processed == 2 and 20 not in rows


def test_streamed_documents_from_a_folder_of_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["streamed_documents"](spark, str(tmp_path))
    want = QUERIES["streamed_documents"](spark, "/root/testdata/sf0.001")
    assert docs.count() == want.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
