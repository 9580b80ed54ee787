"""The document job: text, entities, logos, rewritten text, metrics and audit in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.operators.boxes import (
    classified,
    logo_classes,
    region_plan,
    redaction_plan,
    removable,
    removal_plan,
    suppress,
    sure_boxes,
)
from palimpsest.operators.fuse import mean_confidence
from palimpsest.operators.ocr import all_tokens, combined_tokens, count_tokens, page_text, with_mean
from palimpsest.operators.rewrite import anonymize, audit_rows, mapping
from palimpsest.operators.rules import MaskingRule, apply_rules
from palimpsest.operators.scan import explode_findings
from palimpsest.operators.skew import join_documents, where_computed
from palimpsest.plans.detection import detect
from palimpsest.sources.intake import batch_documents, with_options
from palimpsest.sources.sinks import save_batch_results


@dataclass(frozen=True)
class Processed:
    """Tables of one run: documents, logos, logo removals, text blocks that count, regions to cover.

    Every table is computed anew wherever it is used. A run of which several tables are needed
    should be `written` first.
    """

    documents: DataFrame
    logos: DataFrame | None
    removals: DataFrame | None
    blocks: DataFrame | None = None
    regions: DataFrame | None = None

    def written(self, path: str, mode: str = "error") -> Processed:
        """The same run, computed once, stored under `path` and read from there."""
        spark = self.documents.sparkSession
        stored = {}
        for name in ("documents", "logos", "removals", "blocks", "regions"):
            df = getattr(self, name)
            if df is not None:
                df.write.mode(mode).parquet(f"{path}/{name}")
                df = spark.read.schema(df.schema).parquet(f"{path}/{name}")
            stored[name] = df
        return Processed(**stored)

    def entities(self) -> DataFrame:
        return explode_findings(self.documents, "entities", arrival=False)

    def mapping(self) -> DataFrame:
        return mapping(self.documents)

    def audit(self, run_ts: Column) -> DataFrame:
        return audit_rows(where_computed(self.documents, "success"), run_ts)


def recognised_text(
    docs: DataFrame, ocr_tables: dict[str, DataFrame], key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Documents with their page text, and the tokens that count."""
    tables = ocr_tables
    threshold: Column | float = C.OCR_THRESHOLD
    if "options" in docs.columns:
        limits = docs.select(key, "opt_ocr_confidence")
        tables = {e: join_documents(t, limits, [key]) for e, t in ocr_tables.items()}
        threshold = F.col("opt_ocr_confidence")
    tokens = all_tokens(tables, threshold=threshold, key=key)
    counted = count_tokens(tokens, key)
    pages = with_mean(page_text(tokens, docs, key=key, counted=counted))
    text = pages.select(
        key, F.col("full_text").alias("text"), F.col("average_confidence").alias("ocr_confidence"), F.col("tokens").alias("text_blocks")
    )
    return docs.join(text, key, "left"), combined_tokens(tokens, docs, key=key, counted=counted)


def process_documents(
    docs: DataFrame,
    raw_tables: dict[str, DataFrame] | None = None,
    ocr_tables: dict[str, DataFrame] | None = None,
    boxes: DataFrame | None = None,
    classes: DataFrame | None = None,
    rules: list[MaskingRule] | None = None,
    engines: tuple[str, ...] = C.DOCUMENT_ENGINES,
    nms: bool = False,
    region_method: str = C.REGION_METHOD_FALLBACK,
    key: str = "doc_id",
) -> Processed:
    """Process documents with text, or with OCR tokens in `ocr_tables`.

    A document may carry `options`, `load_error` (it then fails with that message), and the
    image's `width` and `height`. Failed documents stay in the result without any text. With image
    sizes and OCR tokens the run has the regions to cover, and `image_anonymized` says which
    documents have any of their text covered.
    """
    own = with_options(docs)
    blocks = regions = None
    if ocr_tables:
        own, blocks = recognised_text(own, ocr_tables, key)
    if "load_error" not in own.columns:
        own = own.withColumn("load_error", F.lit(None).cast("string"))
    own = own.withColumn("text", F.when(F.col("load_error").isNull(), F.col("text")))
    have_options = "options" in docs.columns
    found = detect(
        own,
        engines=C.ENGINES if have_options else engines,
        raw_tables=raw_tables,
        threshold="opt_pii_confidence",
        row_engines="opt_pii_engines" if have_options else None,
        key=key,
    )
    if rules:
        found = found.withColumn("entities", F.expr(apply_rules("entities", rules)))
    done = anonymize(
        found,
        preserve_format="opt_preserve_format",
        realistic_names="opt_realistic_replacements",
    )
    failed = F.col("load_error").isNotNull()
    done = (
        done.withColumn("success", F.col("success") & ~failed)
        .withColumn("error_message", F.coalesce("load_error", "error_message"))
        .withColumn("anonymized_text", F.when(~failed, F.col("anonymized_text")))
        .withColumn("entities_found", F.size("entities"))
        .withColumn("pii_confidence", F.expr(mean_confidence("entities")))
        .drop("load_error")
    )
    logos = removals = None
    if boxes is not None:
        logos, removals = _logos(boxes, own, classes, have_options, nms, key)
        counts = logos.groupBy(key).agg(
            F.count("*").alias("logos_found"), F.avg("confidence").alias("logo_confidence")
        )
        done = done.join(counts, key, "left")
    else:
        done = done.withColumn("logos_found", F.lit(None).cast("bigint")).withColumn(
            "logo_confidence", F.lit(None).cast("double")
        )
    done = done.withColumn("logos_found", F.coalesce("logos_found", F.lit(0))).withColumn(
        "logo_confidence", F.coalesce("logo_confidence", F.lit(0.0))
    )
    sized = {"width", "height"} <= set(docs.columns)
    if blocks is not None and sized:
        covered = F.col("success") & (F.col("entities_found") > 0) & (F.col("text_blocks") > 0)
        done = done.withColumn("image_anonymized", covered)
        own_blocks = join_documents(blocks, docs.select(key, "width", "height"), [key])
        regions = cover_plan(own_blocks, done, removals, F.lit(region_method), key)
    return Processed(done, logos, removals, blocks, regions)


def _logos(
    boxes: DataFrame,
    docs: DataFrame,
    classes: DataFrame | None,
    have_options: bool,
    nms: bool,
    key: str,
) -> tuple[DataFrame, DataFrame]:
    known = logo_classes(boxes.sparkSession) if classes is None else classes
    threshold: Column | float = C.LOGO_THRESHOLD
    method = F.lit(C.OPTION_DEFAULTS["logo_removal_method"])
    settings = [c for c in ("width", "height") if c in docs.columns]
    if have_options:
        settings += ["opt_logo_confidence", "opt_logo_removal_method"]
        threshold, method = F.col("opt_logo_confidence"), F.col("opt_logo_removal_method")
    own = join_documents(boxes, docs.select(key, *settings), [key]) if settings else boxes
    sure = sure_boxes(own, threshold)
    logos = classified(suppress(sure, key=key) if nms else sure, known)
    gone = removable(logos)
    if {"width", "height"} <= set(logos.columns):
        gone = removal_plan(gone, method)
    return logos, gone


def cover_plan(
    blocks: DataFrame, docs: DataFrame, removals: DataFrame | None, method: Column, key: str = "doc_id"
) -> DataFrame:
    """Regions to cover: blocks (with image size) of documents with entities, and logos."""
    planned = region_plan(blocks, method).withColumn("seq", F.col("place"))
    return redaction_plan(planned, where_computed(docs.select(key, "image_anonymized"), "image_anonymized"), removals, key)


def process_batch(
    batches: DataFrame,
    column: str = "texts",
    path: str | None = None,
    batch_key: str | None = None,
    **options: object,
) -> DataFrame:
    """Process arrays of texts, each text under its own id, and save the results on request.

    `batch_key` names a column that tells batches apart; it becomes part of the ids. Failed
    documents are rows of the result. `batch_pos` restores the input order.
    """
    if batch_key is None and len(batches.select(F.lit(1)).limit(2).collect()) > 1:
        raise ValueError("several batches need a batch_key, or their documents share ids")
    docs = batch_documents(batches, column, batch_key=batch_key)
    if "total_time" not in docs.columns:
        docs = docs.withColumn("total_time", F.lit(None).cast("double"))
    done = process_documents(docs, **options).documents
    if path is None:
        return done
    save_batch_results(done, path)
    return done.sparkSession.read.schema(done.schema).parquet(f"{path}/processed")
