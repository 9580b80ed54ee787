"""Reports over entities and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("ocr", "pii", "logo", "anonymization")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row with the exact median of a column, null when there are no values.

    Each task counts its values per distinct value, and scores have few.
    """
    return df.agg(F.percentile(value, 0.5).alias("median"))


def entity_statistics(entities: DataFrame) -> DataFrame:
    """One row: totals, confidence statistics and sensitive entities; zeros when empty. One pass, a row per task is shuffled."""
    return entities.agg(
        F.count("*").alias("total_entities"),
        F.size(F.collect_set("label")).cast("bigint").alias("unique_labels"),  # labels are few
        F.avg("confidence").alias("mean_confidence"),
        F.stddev_pop("confidence").alias("std_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if("is_sensitive").alias("sensitive_entities"),
        F.percentile("confidence", 0.5).alias("median_confidence"),
    )


def counts_by(entities: DataFrame, column: str) -> DataFrame:
    """Entities per label or per engine."""
    return entities.groupBy(column).agg(F.count("*").alias("entities"))


def counts_rollup(entities: DataFrame) -> DataFrame:
    """Entities per label and engine with the subtotals of each label and the total."""
    return entities.rollup("label", "engine").agg(
        F.count("*").alias("entities"), F.grouping_id().alias("level")
    )


def type_share(entities: DataFrame) -> DataFrame:
    """Entities per label and their share of all."""
    # The window spans the counted rows, one per label.
    total = F.sum("entities").over(Window.partitionBy())
    return counts_by(entities, "label").withColumn("share", F.col("entities") / total)


def document_metrics(
    docs: DataFrame, entities: DataFrame, boxes: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Counts and mean confidences per document, 0 where nothing was found."""
    found = entities.groupBy(key).agg(
        F.count("*").alias("entities_found"), F.avg("confidence").alias("pii_confidence")
    )
    logos = boxes.groupBy(key).agg(
        F.count("*").alias("logos_found"), F.avg("confidence").alias("logo_confidence")
    )
    return (
        docs.select(key)
        .join(found, key, "left")
        .join(logos, key, "left")
        .select(
            key,
            F.coalesce("entities_found", F.lit(0)).alias("entities_found"),
            F.coalesce("pii_confidence", F.lit(0.0)).alias("pii_confidence"),
            F.coalesce("logos_found", F.lit(0)).alias("logos_found"),
            F.coalesce("logo_confidence", F.lit(0.0)).alias("logo_confidence"),
        )
    )


def _ok(column: str) -> Column:
    return F.when(F.col("success"), F.col(column))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def processing_statistics(runs: DataFrame) -> DataFrame:
    """One row over runs (success, stage times, counts, confidences); zeros when empty.

    Means are over successful documents, the success rate is in percent of all.
    """
    ok = F.count_if("success")
    total_time = F.sum(_ok("total_time"))
    means = [
        F.coalesce(F.avg(_ok(f"{stage}_time")), F.lit(0.0)).alias(f"average_{stage}_time")
        for stage in ("total", *STAGES)
    ]
    spread = []
    for name in ("ocr_confidence", "pii_confidence"):
        value = F.when(F.col("success"), F.coalesce(name, F.lit(0.0)))
        spread += [
            F.coalesce(F.avg(value), F.lit(0.0)).alias(f"average_{name}"),
            F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias(f"{name}_std"),
        ]
    return runs.agg(
        F.count("*").alias("total_documents"),
        ok.alias("successful_documents"),
        _ratio(ok * 100.0, F.count("*")).alias("success_rate"),
        F.coalesce(F.sum(_ok("entities_found")), F.lit(0)).alias("total_entities_found"),
        F.coalesce(F.sum(_ok("logos_found")), F.lit(0)).alias("total_logos_found"),
        *means,
        _ratio(ok, total_time).alias("throughput_docs_per_second"),
        *spread,
    )


def entity_type_analysis(entities: DataFrame, runs: DataFrame) -> DataFrame:
    """Distribution of entity types over successful documents, most common type marked.

    Of equally common types the first by name counts as the most common.
    """
    good = runs.where("success")
    counts = counts_by(entities.join(good, "doc_id", "left_semi"), "label")
    docs = good.agg(F.count("*").alias("_docs"))
    # The windows span the counted rows, one per label.
    everything = Window.partitionBy()
    by_count = everything.orderBy(F.col("entities").desc(), F.col("label"))
    return (
        counts.withColumn("_all", F.sum("entities").over(everything))
        .withColumn("most_common", F.row_number().over(by_count) == 1)
        .crossJoin(F.broadcast(docs))
        .select(
            "label",
            "entities",
            _ratio(F.col("_all"), F.col("_docs")).alias("average_entities_per_document"),
            "most_common",
        )
    )


def average_processing_time(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.avg("total_time"), F.lit(0.0)).alias("average_processing_time"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row: counts, mean time of successful documents, entities and logos they hold."""
    return runs.agg(
        F.count("*").alias("total_documents"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.avg(_ok("total_time")), F.lit(0.0)).alias("average_processing_time"),
        F.coalesce(F.sum(_ok("entities_found")), F.lit(0)).alias("total_entities_found"),
        F.coalesce(F.sum(_ok("logos_found")), F.lit(0)).alias("total_logos_found"),
    )


def request_summary(runs: DataFrame) -> DataFrame:
    """One row: counts and times, the mean taken over all documents."""
    total = F.coalesce(F.sum("total_time"), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("total_documents"),
        F.count_if("success").alias("successful_documents"),
        F.count_if(~F.col("success")).alias("failed_documents"),
        total.alias("total_processing_time"),
        _ratio(total, F.count("*")).alias("average_processing_time"),
    )


def dashboard_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("total_processed"),
        F.count_if("success").alias("successful"),
        _ratio(F.count_if("success") * 100.0, F.count("*")).alias("success_rate"),
        F.coalesce(F.avg(_ok("total_time")), F.lit(0.0)).alias("average_time"),
    )


def anonymization_report(
    runs: DataFrame,
    mappings: DataFrame,
    audit_kept: bool = True,
    format_kept: bool = True,
) -> DataFrame:
    """One row over anonymised documents (success, entities_processed, total_time, method)."""
    unique = mappings.agg(F.count_distinct("original").alias("total_unique_values_anonymized"))
    methods = (
        runs.select("method")
        .distinct()
        .agg(F.array_sort(F.collect_list("method")).alias("anonymization_methods_used"))
    )
    total = F.coalesce(F.sum("total_time"), F.lit(0.0))
    entities = F.coalesce(F.sum("entities_processed"), F.lit(0))
    return (
        runs.agg(
            F.count("*").alias("total_documents_processed"),
            F.count_if("success").alias("successful_operations"),
            entities.alias("total_entities_anonymized"),
            total.alias("total_processing_time"),
            _ratio(total, F.count("*")).alias("average_processing_time"),
            (entities > 0).alias("anonymization_performed"),
            F.lit(audit_kept).alias("audit_trail_maintained"),
            F.lit(format_kept).alias("format_preservation"),
        )
        .crossJoin(F.broadcast(unique))
        .crossJoin(F.broadcast(methods))
    )


def stage_times(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and stage with its time."""
    names = ["OCR", "PII Detection", "Logo Detection", "Anonymization"]
    pairs = ", ".join(f"'{n}', {s}_time" for n, s in zip(names, STAGES, strict=True))
    return runs.select(key, F.expr(f"stack({len(STAGES)}, {pairs}) as (stage, seconds)"))


def history(runs: DataFrame) -> DataFrame:
    """Runs in time order as shown to people; failed runs show no counts and no time."""
    ok = F.col("success")
    return runs.orderBy("ts", "filename").select(
        "filename",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(ok, "Success").otherwise("Failed").alias("status"),
        F.when(ok, F.col("entities_found")).otherwise(F.lit(0)).alias("entities"),
        F.when(ok, F.col("logos_found")).otherwise(F.lit(0)).alias("logos"),
        F.when(ok, F.format_string("%.2f", "total_time")).otherwise("N/A").alias("seconds"),
    )


def timeline(runs: DataFrame) -> DataFrame:
    """Time point and duration of each run, 0 when it failed."""
    return runs.select(
        "filename",
        "ts",
        "success",
        F.when(F.col("success"), F.col("total_time")).otherwise(F.lit(0.0)).alias("total_time"),
    )


def percent(value: Column) -> Column:
    """Whole percent, halves to the even number."""
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def display_entities(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities as shown to people."""
    return entities.select(
        key,
        "seq",
        "text",
        F.col("label").alias("type"),
        percent(F.col("confidence")).alias("confidence"),
        "engine",
        F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias(
            "position"
        ),
        F.when(F.col("is_sensitive"), "yes").otherwise("no").alias("sensitive"),
    )
