"""Costly columns are computed once in a plan."""

import pytest
from pyspark.sql import functions as F

from palimpsest.checks import anonymize, documents
from palimpsest.plans.documents import process_documents

FOLDER = "/root/testdata/sf0.001"


def scans(df):
    """How often the optimised plan scans for patterns."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_audit_scans_once(spark):
    run = process_documents(spark.createDataFrame([(1, "EMP000001")], "doc_id long, text string"))
    assert scans(run.audit(F.lit("2024-01-01"))) <= scans(run.documents)


def test_regions_scan_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    once = scans(documents.plain_run(spark, FOLDER).documents)
    assert 0 < scans(documents.covers(spark, FOLDER)) <= once


def test_restoring_scans_what_was_written(spark):
    assert scans(anonymize.restored_log(spark, FOLDER)) == 0
    assert scans(anonymize.reversible(spark, FOLDER)) == 0


@pytest.mark.parametrize("query", ["context_scores", "analysis_counters", "anonymized_access_log"])
def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path, query):
    from __spark_entry__ import queries

    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01'").alias("ts"), (F.col("id") % 50).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.sha2(F.col("id").cast("string"), 512).alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.autoBroadcastJoinThreshold": "10485760"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        done = queries()[query](spark, str(tmp_path))
        sizes = [r["n"] for r in done.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("doc_id").alias("n")).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 4000 and max(sizes) < 1000
