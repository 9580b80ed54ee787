"""Documents and requests coming in: reading, decoding, options and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.text import safe_file_name

OPTIONS = (
    "struct<ocr_confidence:double,pii_confidence:double,logo_confidence:double,"
    "pii_engines:array<string>,logo_removal_method:string,preserve_format:boolean,"
    "realistic_replacements:boolean>"
)
REQUEST = f"struct<images:array<struct<image:string,filename:string>>,options:{OPTIONS}>"

# Output tables of the external engines.
SCHEMAS = {
    "spacy": "doc_id bigint, raw_label string, start int, end_pos int, seq bigint",
    "transformers": "doc_id bigint, entity_group string, start int, end_pos int, score double, "
    "word string, seq bigint",
    "presidio": "doc_id bigint, entity_type string, start int, end_pos int, score double, "
    "seq bigint",
    "easyocr": "doc_id bigint, seq int, quad array<struct<x:double,y:double>>, text string, "
    "confidence double",
    "tesseract": "doc_id bigint, seq int, text string, conf int, left_px int, top_px int, "
    "width int, height int",
    "boxes": "doc_id bigint, seq int, class_id int, confidence double, x1 int, y1 int, x2 int, "
    "y2 int",
}


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents from Parquet, JSON lines or text files, one document per row or file."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text")
        )
    return spark.read.format(fmt).load(path)


def read_engine_output(
    spark: SparkSession, engine: str, path: str, fmt: str = "parquet"
) -> DataFrame:
    """One external engine's table with its fixed schema."""
    return spark.read.schema(SCHEMAS[engine]).format(fmt).load(path)


def default_id(place: str, batch_key: str | None) -> Column:
    """`batch_doc_<place>`, with the batch's key before the place where there are several batches."""
    parts = [F.lit("batch_doc_")]
    if batch_key is not None:
        parts += [F.col(batch_key).cast("string"), F.lit("_")]
    return F.concat(*parts, F.col(place).cast("string"))


def batch_documents(
    batches: DataFrame, column: str, id_column: str | None = None, batch_key: str | None = None
) -> DataFrame:
    """One row per element of an array of texts.

    An id that is missing is `batch_doc_<place>`, unique in one batch. Several batches need a
    `batch_key`, which becomes part of it.
    """
    rows = batches.select("*", F.posexplode(column).alias("batch_pos", "text")).drop(column)
    given = F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")
    return rows.withColumn("doc_id", F.coalesce(given, default_id("batch_pos", batch_key)))


def parse_requests(
    bodies: DataFrame, body: str = "body", batch_key: str | None = None
) -> DataFrame:
    """One row per image of a batch request, with its place, file name, payload and options."""
    request = F.from_json(F.col(body), REQUEST)
    kept = [c for c in bodies.columns if c != body]
    return (
        bodies.select(*kept, request.alias("_request"))
        .select(
            *kept,
            F.col("_request.options").alias("options"),
            F.posexplode("_request.images").alias("batch_pos", "_image"),
        )
        .select(
            *kept,
            "batch_pos",
            F.coalesce("_image.filename", default_id("batch_pos", batch_key)).alias("document_id"),
            F.coalesce("_image.image", F.lit("")).alias("image"),
            "options",
        )
    )


def decoded_payload(payload: Column) -> Column:
    """Bytes of a base64 text with or without `data:` header; null when it is not base64."""
    parts = F.split(payload, ",")
    bare = F.when(F.contains(payload, F.lit(",")), F.get(parts, F.lit(1))).otherwise(payload)
    return F.try_to_binary(bare, F.lit("base64"))


def decode_images(requests: DataFrame, payload: str = "image") -> DataFrame:
    """Adds `content` and, for a bad payload, `error_message`."""
    return requests.withColumn("content", decoded_payload(F.col(payload))).withColumn(
        "error_message",
        F.when(
            F.col("content").isNull() | (F.length("content") == 0), "Invalid base64 image data"
        ),
    )


def document_id(file_name: str) -> Column:
    """Safe document id from an uploaded file's name."""
    return F.expr(safe_file_name(file_name))


def with_options(docs: DataFrame, options: str | None = "options") -> DataFrame:
    """Adds `opt_<name>` per option: the document's own value or the default."""
    have = options is not None and options in docs.columns
    out = docs
    for name, value in C.OPTION_DEFAULTS.items():
        if isinstance(value, tuple):
            default = F.array(*[F.lit(v) for v in value])
        else:
            default = F.lit(value)
        out = out.withColumn(
            f"opt_{name}", F.coalesce(f"{options}.{name}", default) if have else default
        )
    return out


def reject_reason(
    columns: list[str],
    max_text_chars: int = C.MAX_TEXT_CHARS,
    max_file_bytes: int = C.MAX_FILE_BYTES,
    max_batch: int = C.MAX_BATCH,
) -> Column:
    """First broken intake rule of a row, or null. Rules on absent columns are skipped."""
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    rules = {
        "text": (F.length("text") > max_text_chars, "text too long"),
        "size_bytes": (F.col("size_bytes") > max_file_bytes, "file too large"),
        "batch_pos": (F.col("batch_pos") >= max_batch, "batch too large"),
        "mime": (~F.col("mime").isin(*C.ALLOWED_MIME), "type not allowed"),
        "filename": (~extension.isin(*C.ALLOWED_EXTENSIONS), "extension not allowed"),
    }
    reasons = [F.when(rule, why) for name, (rule, why) in rules.items() if name in columns]
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def validate(docs: DataFrame, **limits: int) -> DataFrame:
    return docs.withColumn("reject_reason", reject_reason(docs.columns, **limits))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason is null").drop("reject_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason is not null")


def entity_catalogue(spark: SparkSession) -> DataFrame:
    """Known entity types with their group and the engine keys."""
    rows = [(label, "standard") for label in C.STANDARD_ENTITIES]
    rows += [(label, "security_specific") for label in C.SECURITY_ENTITIES]
    rows += [(engine, "engines") for engine in C.ENGINES]
    return spark.createDataFrame(rows, "name string, kind string")


def unknown_labels(entities: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Labels in use that the catalogue does not list, with their number of entities."""
    known = catalogue.where("kind <> 'engines'").select(F.col("name").alias("label"))
    counts = entities.groupBy("label").agg(F.count("*").alias("entities"))
    return counts.join(known, "label", "left_anti")


def unknown_documents(tables: dict[str, DataFrame], docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of token and box tables whose document is not there: they take no part in a run, and are listed with their source and why.

    `tables` has them by source; each has `key` and `seq`. Rows without a document's id are listed as well.
    """
    known = docs.select(key).distinct()
    out = None
    for source, rows in tables.items():
        lost = rows.select(key, F.lit(source).alias("source"), "seq").join(known, key, "left_anti")
        out = lost if out is None else out.unionByName(lost)
    if out is None:
        raise ValueError("no tables")
    return out.withColumn("reason", F.when(F.col(key).isNull(), "no document id").otherwise("unknown document"))
