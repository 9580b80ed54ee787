"""Registered queries: intake, the whole document job, responses and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks import sql as S
from palimpsest.checks.boxes import LOGO_CTES, logos
from palimpsest.checks.ocr import ocr_tables, page_ctes, page_ids
from palimpsest.checks.tables import table, with_tables
from palimpsest.functions import constants as C
from palimpsest.operators.skew import shared_folder
from palimpsest.plans.detection import detect
from palimpsest.plans.documents import Processed, process_batch, process_documents
from palimpsest.sources import intake
from palimpsest.sources.sinks import detection_rows, reports, responses, written_in_order
from palimpsest.streaming.streams import anonymized_stream, document_stream, run_available

Query = Callable[[SparkSession, str], DataFrame]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies with three images each: with header, bare, and broken."""
    body = r"""concat('{"images":[{"image":"data:image/png;base64,',
      regexp_replace(base64(encode(text, 'UTF-8')), '\\s', ''),
      '","filename":"scan ', doc_id, '.png"},{"image":"', base64(encode(source, 'UTF-8')),
      '"},{"image":"%%%","filename":"x"}]',
      if(doc_id % 2 = 0, ',"options":{"pii_confidence":0.9,"pii_engines":["spacy"]}', ''), '}')"""
    return table(spark, sf, "documents").select("doc_id", F.expr(body).alias("body"))


def request_images(spark: SparkSession, sf: str) -> DataFrame:
    parsed = intake.decode_images(intake.parse_requests(requests(spark, sf)))
    return intake.with_options(parsed).select(
        "doc_id",
        "batch_pos",
        "document_id",
        F.when(F.col("error_message").isNull(), F.sha2("content", 256)).alias("content_hash"),
        "error_message",
        F.col("opt_pii_confidence").alias("pii_confidence"),
        F.array_join("opt_pii_engines", ",").alias("pii_engines"),
        F.col("opt_logo_removal_method").alias("logo_removal_method"),
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the particulars of an upload."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.expr("repeat(text, if(doc_id % 50 = 0, cast(1000000 div greatest(length(text), 1) as int) + 1, 1))").alias("text"),
        (F.col("n_chars") * 5000).alias("size_bytes"),
        (F.col("doc_id") % 25).alias("batch_pos"),
        F.expr(
            "element_at(array('image/png', 'image/jpeg', 'text/plain', 'image/bmp'), "
            "cast(doc_id % 4 as int) + 1)"
        ).alias("mime"),
        F.expr(
            "concat('file', doc_id, element_at(array('.PNG', '.jpg', '.gif', '.tiff', ''), "
            "cast(doc_id % 5 as int) + 1))"
        ).alias("filename"),
    )


def reasons(spark: SparkSession, sf: str) -> DataFrame:
    return intake.validate(uploads(spark, sf)).select("doc_id", "reject_reason")


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        intake.document_id("concat('../my files/', url, ' (', page_id, ').png')").alias("safe_name"),
    )


def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    batches = (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
        .select("conv_id", F.expr("transform(turns, t -> t.text)").alias("texts"))
    )
    return intake.batch_documents(batches, "texts").select("conv_id", "batch_pos", "doc_id", "text")


OPTIONS = """named_struct(
 'ocr_confidence', if(doc_id % 4 = 0, 0.8D, null),
 'pii_confidence', if(doc_id % 7 = 0, 0.9D, null),
 'logo_confidence', if(doc_id % 3 = 0, 0.75D, null),
 'pii_engines', if(doc_id % 6 = 0, array('spacy', 'transformers'), null),
 'logo_removal_method', case when doc_id % 5 = 0 then 'blur' when doc_id % 5 = 1 then 'shred' end,
 'preserve_format', if(doc_id % 8 = 0, false, null),
 'realistic_replacements', cast(null as boolean))"""


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned documents with image size and options; some cannot be loaded."""
    return page_ids(spark, sf).select(
        "doc_id",
        (F.col("doc_id") % 50 + 40).cast("int").alias("width"),
        (F.col("doc_id") % 40 + 30).cast("int").alias("height"),
        F.expr(OPTIONS).alias("options"),
    )


def processed(spark: SparkSession, sf: str) -> Processed:
    return process_documents(
        scans(spark, sf),
        ocr_tables=ocr_tables(spark, sf),
        boxes=table(spark, sf, "detections_raw"),
    )


def job(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).documents.select(
        "doc_id",
        "success",
        "error_message",
        "text",
        "anonymized_text",
        F.col("entities_found").cast("bigint").alias("entities_found"),
        F.round("pii_confidence", 6).alias("pii_confidence"),
        F.round("ocr_confidence", 6).alias("ocr_confidence"),
        "logos_found",
        F.round("logo_confidence", 6).alias("logo_confidence"),
    )


def removals(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).removals.select(
        "doc_id", "seq", "class_name", "x1", "y1", "x2", "y2", "method"
    )


def plain_run(spark: SparkSession, sf: str) -> Processed:
    return process_documents(
        scans(spark, sf).drop("options"),
        ocr_tables=ocr_tables(spark, sf),
        boxes=table(spark, sf, "detections_raw"),
    )


def covers(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of the page tokens that count of documents with entities, and the logos to remove."""
    return plain_run(spark, sf).regions


def image_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of scanned documents; images of those with entities are covered."""
    rows = plain_run(spark, sf).audit(F.lit("2024-01-01 00:00:00"))
    return rows.select("doc_id", "entities_processed", "text_anonymized", "image_anonymized")


def failing(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of which some could not be loaded: they fail and give no text."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.expr("if(doc_id % 9 = 0, concat('Could not load image from ', source), null)").alias(
            "load_error"
        ),
    )
    return process_documents(docs).documents.select(
        "doc_id",
        "success",
        "error_message",
        "anonymized_text",
        F.col("entities_found").cast("bigint").alias("entities_found"),
    )


RESPONSE = (
    "struct<success:boolean,document_id:bigint,extracted_text:string,anonymized_text:string,"
    "entities:array<struct<text:string,label:string,start:int,end:int,confidence:double,"
    "engine:string,is_sensitive:boolean>>,"
    "processing_metrics:struct<total_time:double,confidence_scores:struct<pii:double,logo:double>,"
    "entities_found:bigint,logos_found:bigint>,"
    "logos:array<struct<class_name:string,confidence:double,bbox:array<int>,area:bigint>>,"
    "anonymization_mapping:array<struct<original:string,anonymized:string>>>"
)


def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JSON responses, read back so that their content can be compared."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1.5).alias("total_time"))
    run = process_documents(docs, boxes=table(spark, sf, "detections_raw"))
    out = responses(run.documents, run.logos)
    parsed = out.select(F.from_json("response", RESPONSE).alias("r"))
    return parsed.select(
        F.col("r.success").alias("success"),
        F.col("r.document_id").alias("doc_id"),
        F.sha2("r.extracted_text", 256).alias("text_hash"),
        F.sha2("r.anonymized_text", 256).alias("anonymized_hash"),
        F.expr(
            "array_join(transform(r.entities, e -> concat_ws(' ', e.label, e.engine, "
            "cast(e.is_sensitive as string))), ',')"
        ).alias("labels"),
        F.col("r.processing_metrics.total_time").alias("total_time"),
        F.round("r.processing_metrics.confidence_scores.pii", 6).alias("pii_score"),
        F.round("r.processing_metrics.confidence_scores.logo", 6).alias("logo_score"),
        F.col("r.processing_metrics.entities_found").alias("entities_found"),
        F.col("r.processing_metrics.logos_found").alias("logos_found"),
        F.expr(
            "array_join(transform(r.logos, l -> concat(l.class_name, ' ', "
            "array_join(transform(l.bbox, x -> cast(x as string)), ' '))), ',')"
        ).alias("logos"),
        F.size("r.anonymization_mapping").cast("bigint").alias("mappings"),
    )


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1.5).alias("total_time"))
    out = reports(process_documents(docs, boxes=table(spark, sf, "detections_raw")).documents)
    fields = "struct<document_id:bigint,processing_time:double,entities_found:bigint,logos_found:bigint>"
    return out.select(F.from_json("report", fields).alias("r")).select("r.*")


def exported_detections(spark: SparkSession, sf: str) -> DataFrame:
    return detection_rows(logos(spark, sf)).withColumn(
        "bbox", F.array_join(F.col("bbox").cast("array<string>"), ",")
    )


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read as a stream, rewritten, appended to a table; the table is the result."""
    folder = shared_folder(spark)
    schema = table(spark, sf, "documents").schema
    # as a glob the name stands for a file as well as for a folder of files
    stream = document_stream(spark, f"{sf}/documents.parque[t]", schema).select("doc_id", "text")
    out = anonymized_stream(stream).select("doc_id", "anonymized_text", "entities_processed")
    run_available(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """One batch per conversation: its turns, each with a badge and an address."""
    contact = "concat(text, ' Ref B-', lpad(cast(conv_id as string), 6, '0'), ' or turn', turn, '@mail.example.org')"
    return (
        table(spark, sf, "conversations")
        .select("conv_id", "turn", F.col("text").alias("said"), F.expr(contact).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "said", "text"))).alias("turns"))
        .select("conv_id", F.expr("transform(turns, t -> t.text)").alias("texts"))
    )


def batch_job(spark: SparkSession, sf: str) -> DataFrame:
    """Several batches in one job: their results are saved and read back."""
    done = process_batch(batches(spark, sf), path=shared_folder(spark), batch_key="conv_id")
    return done.select(
        "doc_id", "conv_id", "batch_pos", "success", "anonymized_text", F.col("entities_found").cast("bigint").alias("entities_found")
    )


def batch_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Results in the order their texts came in; the place each takes when written so."""
    done = process_batch(batches(spark, sf), batch_key="conv_id").select("doc_id", "conv_id", "batch_pos")
    placed = written_in_order(done, f"{shared_folder(spark)}/ordered", "conv_id", "batch_pos")
    return placed.select("doc_id", F.col("place").cast("int").alias("place"))


def reduced_engines(spark: SparkSession, sf: str) -> DataFrame:
    """An engine without table finds nothing and is not listed as used."""
    done = detect(table(spark, sf, "access_log"), engines=("spacy", "transformers", "custom_patterns"))
    return done.select(
        "doc_id",
        F.array_join("engines_used", ",").alias("engines_used"),
        F.size("entities").cast("bigint").alias("entities"),
    )


QUERIES: dict[str, Query] = {
    "request_images": request_images,
    "intake_validation": reasons,
    "safe_file_names": safe_names,
    "batch_document_ids": batch_ids,
    "processed_documents": job,
    "processed_removals": removals,
    "redaction_plan": covers,
    "image_audit": image_audit,
    "batch_job": batch_job,
    "batch_in_order": batch_in_order,
    "failed_documents": failing,
    "response_rows": response_rows,
    "report_rows": report_rows,
    "detection_export": exported_detections,
    "engines_used": reduced_engines,
    "streamed_documents": streamed,
}

SIZES = "(doc_id % 50 + 40)::INT as width, (doc_id % 40 + 30)::INT as height"
_SCANS = f"""opts as (select doc_id, {SIZES},
  case when doc_id % 4 = 0 then 0.8::DOUBLE else 0.7::DOUBLE end as ocr_cut,
  case when doc_id % 7 = 0 then 0.9::DOUBLE else 0.8::DOUBLE end as pii_cut,
  case when doc_id % 3 = 0 then 0.75::DOUBLE else 0.6::DOUBLE end as logo_cut,
  case doc_id % 5 when 0 then 'blur' when 1 then 'black_box' else 'inpaint' end as method
 from (select distinct l_orderkey as doc_id from li))"""
_PAGES = page_ctes(cut="ocr_cut", docs="opts") + ",\nscan_text as (select doc_id, full_text as text from page)"
_JOB = S.detection(
    f"{with_tables('easyocr_flat', 'tesseract_raw', 'detections_raw')}, {_SCANS},\n{_PAGES}",
    "scan_text",
    S.all_rules(),
    0.0,
)
# A document that asks for engines without tables has no findings.
_JOB = _JOB.replace("found as (", "found_all as (", 1).replace(
    "scored as (", "found as (select * from found_all where doc_id % 6 <> 0),\nscored as (", 1
).replace(
    "confidence >= 0.0::DOUBLE", "confidence >= (select pii_cut from opts o where o.doc_id = merged.doc_id)"
)
_FORMAT = S.auto_sql().replace(
    S.strategy_sql("replace_format"),
    f"(case when doc_id % 8 = 0 then '[' || label || ']' else {S.strategy_sql('replace_format')} end)",
)
_JOB = f"{_JOB},\n{S.rewritten_ctes('scan_text', _FORMAT)}"
_JOB_LOGOS = LOGO_CTES.replace(
    "where confidence >= 0.6::DOUBLE", "join opts using (doc_id) where confidence >= logo_cut"
)
_PLAIN = S.detection(
    f"{with_tables('easyocr_flat', 'tesseract_raw', 'detections_raw')},\n{page_ctes()},\n"
    "scan_text as (select doc_id, full_text as text from page)",
    "scan_text",
    S.all_rules(),
    0.8,
)
_DOCS = S.detection("", "documents", S.all_rules(), 0.8) + ",\n" + S.rewritten_ctes(
    "documents", S.auto_sql()
)
_WITH_LOGOS = _DOCS.replace("with recursive ", f"{with_tables('detections_raw')}, {LOGO_CTES},\n", 1)

_TURNS = S.detection(
    """with recursive batch_texts as (select *, 'batch_doc_' || conv_id || '_' || batch_pos as doc_id from (
 select conv_id, (row_number() over (partition by conv_id order by turn, text) - 1)::INT as batch_pos,
 text || ' Ref B-' || lpad(conv_id::VARCHAR, 6, '0') || ' or turn' || turn || '@mail.example.org' as text from conversations))""",
    "batch_texts",
    S.all_rules(),
    0.8,
) + ",\n" + S.rewritten_ctes("batch_texts", S.auto_sql())

ORACLES: dict[str, str] = {
    "request_images": """select doc_id, 0 as batch_pos, 'scan ' || doc_id || '.png' as document_id,
 case when text <> '' then sha256(text) end as content_hash,
 case when text = '' then 'Invalid base64 image data' end as error_message,
 case when doc_id % 2 = 0 then 0.9::DOUBLE else 0.8::DOUBLE end as pii_confidence,
 case when doc_id % 2 = 0 then 'spacy' else 'presidio,spacy,custom_patterns' end as pii_engines,
 'inpaint' as logo_removal_method from documents
union all select doc_id, 1, 'batch_doc_1', sha256(source), null,
 case when doc_id % 2 = 0 then 0.9::DOUBLE else 0.8::DOUBLE end,
 case when doc_id % 2 = 0 then 'spacy' else 'presidio,spacy,custom_patterns' end, 'inpaint' from documents
union all select doc_id, 2, 'x', null, 'Invalid base64 image data',
 case when doc_id % 2 = 0 then 0.9::DOUBLE else 0.8::DOUBLE end,
 case when doc_id % 2 = 0 then 'spacy' else 'presidio,spacy,custom_patterns' end, 'inpaint' from documents""",
    "intake_validation": """select doc_id, case
 when doc_id % 50 = 0 and length(text) > 0 then 'text too long'
 when n_chars * 5000 > 52428800 then 'file too large'
 when doc_id % 25 >= 20 then 'batch too large' when doc_id % 4 = 2 then 'type not allowed'
 when doc_id % 5 in (2, 4) then 'extension not allowed' end as reject_reason from documents""",
    "safe_file_names": r"""select page_id, regexp_replace(regexp_replace(array_to_string(list_filter(
  string_split_regex('../my files/' || url || ' (' || page_id || ').png', '[/\s]+'),
  lambda p: p <> ''), '_'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') as safe_name
from pages""",
    "batch_document_ids": """select conv_id,
 (row_number() over (partition by conv_id order by turn, text) - 1)::INT as batch_pos,
 'batch_doc_' || (row_number() over (partition by conv_id order by turn, text) - 1) as doc_id, text
from conversations""",
    "processed_documents": f"""{_JOB}, {_JOB_LOGOS} select p.doc_id, true as success,
 null::VARCHAR as error_message, p.full_text as text, r.anonymized_text,
 coalesce(e.n, 0) as entities_found, round(coalesce(e.c, 0), 6) as pii_confidence,
 p.average_confidence as ocr_confidence, coalesce(l.n, 0) as logos_found,
 round(coalesce(l.c, 0), 6) as logo_confidence
from page p join rewritten r using (doc_id)
left join (select doc_id, count(*) as n, avg(confidence) as c from entities group by all) e using (doc_id)
left join (select doc_id, count(*) as n, avg(confidence) as c from logos group by all) l using (doc_id)""",
    "processed_removals": f"""{with_tables('detections_raw')}, {_SCANS}, {_JOB_LOGOS}
select doc_id, seq, class_name, greatest(0, x1 - pad)::INT as x1, greatest(0, y1 - pad)::INT as y1,
 least(width, x2 + pad)::INT as x2, least(height, y2 + pad)::INT as y2, method
from (select *, case method when 'inpaint' then 5 else 0 end as pad
 from logos join opts using (doc_id) where confidence >= 0.7::DOUBLE and sensitive)""",
    "redaction_plan": f"""{_PLAIN}, {LOGO_CTES} select * from (
 select doc_id, 'text' as source, seq, greatest(0, x1)::INT as x1, greatest(0, y1)::INT as y1,
  least(width, x2)::INT as x2, least(height, y2)::INT as y2, 'blur' as method
 from (select *, place as seq, {SIZES} from (select * exclude (seq) from used)) where doc_id in (select doc_id from entities))
where x2 > x1 and y2 > y1
union all select doc_id, 'logo', seq, greatest(0, x1 - 5)::INT, greatest(0, y1 - 5)::INT,
 least(width, x2 + 5)::INT, least(height, y2 + 5)::INT, 'inpaint'
from (select *, {SIZES} from logos where confidence >= 0.7::DOUBLE and sensitive)""",
    "failed_documents": f"""{_DOCS} select r.doc_id, r.doc_id % 9 <> 0 as success,
 case when r.doc_id % 9 = 0 then 'Could not load image from ' || d.source end as error_message,
 case when r.doc_id % 9 <> 0 then r.anonymized_text end as anonymized_text,
 case when r.doc_id % 9 <> 0 then r.entities_processed else 0 end::BIGINT as entities_found
from rewritten r join documents d using (doc_id)""",
    "response_rows": f"""{_WITH_LOGOS} select true as success, d.doc_id,
 sha256(d.text) as text_hash, sha256(r.anonymized_text) as anonymized_hash,
 coalesce(e.labels, '') as labels, coalesce(l.logos, '') as logos, r.entities_processed::BIGINT as mappings,
 1.5::DOUBLE as total_time, round(coalesce(e.c, 0), 6) as pii_score, round(coalesce(l.c, 0), 6) as logo_score,
 r.entities_processed::BIGINT as entities_found, coalesce(l.n, 0) as logos_found
from documents d join rewritten r using (doc_id)
left join (select doc_id, string_agg(label || ' ' || engine || ' ' || is_sensitive::VARCHAR, ',' order by start) as labels,
 avg(confidence) as c from entities group by all) e
 using (doc_id)
left join (select doc_id, string_agg(class_name || ' ' || x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ','
  order by confidence desc, seq) as logos, avg(confidence) as c, count(*) as n from logos group by all) l using (doc_id)""",
    "image_audit": f"""{_PLAIN},\n{S.rewritten_ctes('scan_text', S.auto_sql())} select r.doc_id, r.entities_processed,
 length(r.anonymized_text) > 0 as text_anonymized, r.entities_processed > 0 as image_anonymized from rewritten r""",
    "batch_job": f"""{_TURNS} select r.doc_id as doc_id, t.conv_id, t.batch_pos, true as success, r.anonymized_text,
 r.entities_processed::BIGINT as entities_found from rewritten r join batch_texts t using (doc_id)""",
    "batch_in_order": f"""{_TURNS} select r.doc_id as doc_id,
 row_number() over (order by t.conv_id, t.batch_pos)::INT - 1 as place from rewritten r join batch_texts t using (doc_id)""",
    "report_rows": f"""{_WITH_LOGOS} select d.doc_id as document_id, 1.5::DOUBLE as processing_time,
 r.entities_processed::BIGINT as entities_found, coalesce(l.n, 0) as logos_found
from documents d join rewritten r using (doc_id)
left join (select doc_id, count(*) as n from logos group by all) l using (doc_id)""",
    "detection_export": f"""{with_tables('detections_raw')}, {LOGO_CTES} select doc_id,
 x1 || ',' || y1 || ',' || x2 || ',' || y2 as bbox, confidence, class_name, area from logos""",
    "engines_used": S.detection(with_tables("access_log"), "access_log", S.security_rules(), 0.7)
    + """ select d.doc_id, 'custom_patterns' as engines_used, coalesce(e.n, 0) as entities
from access_log d left join (select doc_id, count(*) as n from entities group by all) e using (doc_id)""",
    "streamed_documents": f"{_DOCS} select doc_id, anonymized_text, entities_processed from rewritten",
}
