"""Results going out: tables, JSON lines, text and response rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.boxes import BOX
from palimpsest.operators.ordered import running_counts, stored
from palimpsest.operators.skew import join_dimension
from palimpsest.operators.stats import batch_summary


def export_ocr(
    analysis: DataFrame, path: str, fmt: str = "json", mode: str = "error", blocks: DataFrame | None = None, key: str = "doc_id"
) -> None:
    """OCR results as JSON lines, with their text blocks if given, or the page texts alone."""
    if fmt.lower() == "json":
        ocr_results(analysis, blocks, key).write.mode(mode).json(path)
    elif fmt.lower() == "txt":
        analysis.select("full_text").write.mode(mode).text(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def ocr_results(analysis: DataFrame, blocks: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Page results with `text_blocks`, an array in reading order of the engines' tokens that count."""
    if blocks is None:
        return analysis
    block = F.struct("place", "text", "confidence", F.array(*BOX).alias("bbox"), "engine", "language")
    lists = blocks.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("text_blocks"))
    return analysis.join(lists, key, "left")


def detection_rows(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detections in their exported form."""
    return boxes.select(key, F.array(*BOX).alias("bbox"), "confidence", "class_name", "area")


def export_detections(boxes: DataFrame, path: str, mode: str = "error") -> None:
    detection_rows(boxes).write.mode(mode).json(path)


def export_mapping(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Mapping rows as JSON lines and, counted from what was written, their number."""
    rows.write.mode(mode).json(f"{path}/mappings")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{path}/mappings")
    written.agg(F.count("*").alias("total_mappings")).write.mode(mode).json(f"{path}/summary")


def logo_rows(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Logos per document as one array, the surest first."""
    logo = F.struct(
        (-F.col("confidence")).alias("_rank"), "seq", "class_name", "confidence", F.array(*BOX).alias("bbox"), "area"
    )
    bare = (
        "transform(_logos, l -> named_struct('class_name', l.class_name, 'confidence', "
        "l.confidence, 'bbox', l.bbox, 'area', l.area))"
    )
    rows = boxes.groupBy(key).agg(F.array_sort(F.collect_list(logo)).alias("_logos"))
    return rows.select(key, F.expr(bare).alias("logos"))


TIMES = ("total_time", "ocr_time", "pii_detection_time", "logo_detection_time", "anonymization_time")
SCORES = {"ocr": "ocr_confidence", "pii": "pii_confidence", "logo": "logo_confidence"}


def processing_metrics(columns: list[str]) -> Column:
    """Times, confidence scores and counts of a document; null where a column is absent."""

    def own(name: str, kind: str) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast(kind)

    return F.struct(
        *[own(t, "double").alias(t) for t in TIMES],
        F.struct(*[own(c, "double").alias(k) for k, c in SCORES.items()]).alias("confidence_scores"),
        own("entities_found", "bigint").alias("entities_found"),
        own("logos_found", "bigint").alias("logos_found"),
    )


def responses(docs: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One JSON response per document.

    `docs` carries text, entities, replacements, anonymized_text, success and error_message.
    """
    entity = (
        "transform(entities, e -> named_struct('text', e.text, 'label', e.label, 'start', "
        "e.start, 'end', e.end, 'confidence', e.confidence, 'engine', e.engine, "
        "'is_sensitive', e.is_sensitive))"
    )
    pairs = "transform(replacements, r -> named_struct('original', r.text, 'anonymized', r.anonymized))"
    joined = docs.join(logo_rows(boxes, key), key, "left")
    body = F.struct(
        F.col("success"),
        F.col(key).alias("document_id"),
        F.col("text").alias("extracted_text"),
        F.col("anonymized_text"),
        F.expr(entity).alias("entities"),
        F.coalesce("logos", F.array()).alias("logos"),
        processing_metrics(docs.columns).alias("processing_metrics"),
        F.expr(pairs).alias("anonymization_mapping"),
        F.col("error_message"),
    )
    return joined.select(key, F.to_json(body).alias("response"))


def reports(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One JSON report per document (needs total_time, entities, logos_found, replacements)."""
    pairs = "transform(replacements, r -> named_struct('original', r.text, 'anonymized', r.anonymized))"
    body = F.struct(
        F.col(key).alias("document_id"),
        F.col("total_time").alias("processing_time"),
        F.size("entities").alias("entities_found"),
        F.col("logos_found").alias("logos_found"),
        F.expr(pairs).alias("anonymization_mapping"),
    )
    return docs.select(key, F.to_json(body).alias("report"))


def save_batch_results(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Write processed documents, then summary, texts, results and errors derived from them: all of them, or nothing.

    The processed table is written once and read back, so nothing is computed twice. Everything is written to a
    folder beside `path`, which takes its name when it is whole: a run that fails leaves no half-written set at `path`, and one
    that is repeated starts anew. With mode `overwrite` the set before goes only then.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"Unsupported mode: {mode}")
    spark = docs.sparkSession
    folders = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "error" and folders.exists(target):
        raise FileExistsError(path)
    own = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    docs.write.parquet(f"{own}/processed")
    done = spark.read.schema(docs.schema).parquet(f"{own}/processed")
    batch_summary(done).write.json(f"{own}/batch_summary")
    good = done.where("success")
    good.select("doc_id", "anonymized_text").write.parquet(f"{own}/anonymized_text")
    ocr = F.col("ocr_confidence") if "ocr_confidence" in docs.columns else F.lit(None)
    good.select(
        "doc_id",
        F.length("text").alias("extracted_text_length"),
        "entities_found",
        "logos_found",
        "total_time",
        ocr.cast("double").alias("ocr_confidence"),
        "pii_confidence",
        "logo_confidence",
        F.expr(
            "transform(replacements, r -> "
            "named_struct('original', r.text, 'anonymized', r.anonymized))"
        ).alias("anonymization_mapping"),
    ).write.json(f"{own}/processing_results")
    done.where("not success").select(
        "doc_id", F.coalesce("error_message", F.lit("Unknown error")).alias("error")
    ).write.json(f"{own}/errors")
    if mode == "overwrite":
        folders.delete(target, True)
    if not folders.rename(spark._jvm.org.apache.hadoop.fs.Path(own), target):
        raise FileExistsError(path)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, as Spark reaches it."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


RESULT = (
    "doc_id {key}, extracted_text_length int, entities_found bigint, logos_found bigint, total_time double, ocr_confidence double, "
    "pii_confidence double, logo_confidence double, anonymization_mapping array<struct<original:string,anonymized:string>>"
)


def saved_batch(spark: SparkSession, path: str) -> DataFrame:
    """A saved set as one row per document: text and results of those that succeeded, the error of the others, and the number of
    documents in the summary."""
    processed = spark.read.parquet(f"{path}/processed")
    key = processed.schema["doc_id"].dataType.simpleString()
    texts = spark.read.parquet(f"{path}/anonymized_text")
    results = spark.read.schema(RESULT.format(key=key)).json(f"{path}/processing_results")
    errors = spark.read.schema(f"doc_id {key}, error string").json(f"{path}/errors")
    summary = spark.read.schema("total_documents bigint, successful bigint, failed bigint").json(f"{path}/batch_summary")
    rows = processed.select("doc_id", "success").join(texts, "doc_id", "left").join(results, "doc_id", "left").join(errors, "doc_id", "left")
    return rows.crossJoin(F.broadcast(summary))  # the summary is one row


def in_input_order(docs: DataFrame, *position: str) -> DataFrame:
    """Rows in the order they came in, by `batch_pos` alone or the columns given; sort only where a sink needs it."""
    return docs.orderBy(*(position or ("batch_pos",)))


def written_in_order(docs: DataFrame, path: str, *position: str) -> DataFrame:
    """Rows written in input order and read back with `place`, their number from 0 in that order.

    The sort leaves ranges in order, and a row's place in its own range is known as it is written. What comes before a
    range are the counts of those ahead of it, a row each; no task sees more rows than a range has.
    """
    at = F.monotonically_increasing_id()
    in_input_order(docs, *position).withColumn("_at", at).write.parquet(path)
    stored = docs.sparkSession.read.schema(docs.withColumn("_at", at).schema).parquet(path)
    parts = stored.withColumn("_part", F.shiftright("_at", 33))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    placed = join_dimension(parts, running_counts(counts, "_part", "_n", "_before"), ["_part"])
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("place", F.col("_before") + own).drop("_at", "_part", "_before")


def write_bucketed(df: DataFrame, table: str, key: str = "doc_id", buckets: int = 200, mode: str = "error") -> DataFrame:
    """A table of the session's catalogue, bucketed and sorted by document, and read back.

    Tables of one number of buckets meet and are gathered per document without a shuffle. Choose the number so that a bucket of the
    largest table is a partition's worth; a document with a large share of the rows makes its bucket long. A bucket is one task later
    on, so there should be more of them than cores. Each is written by one task as one file; else every task would write a file a bucket.
    """
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def upsert_mapping(new: DataFrame, path: str, run: str, parts: int = 64) -> None:
    """Bring the mapping (`original`, `anonymized`) of a run into a mapping table; later runs win.

    `run` tells runs apart and orders them. The table is partitioned by a hash of the value, and only partitions that the run has
    values of are rewritten, in one commit. Bringing the same run in again changes nothing.
    """
    spark = new.sparkSession
    schema = "original string, anonymized string, run string, part int"
    own = new.select("original", "anonymized", F.lit(run).alias("run"), F.pmod(F.xxhash64("original"), F.lit(parts)).cast("int").alias("part"))
    own = stored(own)
    rows = own
    if _file_system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        touched = [r.part for r in own.select("part").distinct().collect()]  # at most `parts` numbers
        rows = own.unionByName(spark.read.schema(schema).parquet(path).where(F.col("part").isin(touched)))
    latest = rows.groupBy("part", "original").agg(F.max(F.struct("run", "anonymized")).alias("l"))
    out = latest.select("original", "l.anonymized", "l.run", "part").repartition("part")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The mapping table: one replacement per original."""
    return spark.read.schema("original string, anonymized string, run string, part int").parquet(path).drop("part")
