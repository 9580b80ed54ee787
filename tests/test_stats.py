import random
import statistics

import pytest

from pyspark.sql import functions as F

from palimpsest.operators import stats

ENTITY = "doc_id long, label string, engine string, confidence double, is_sensitive boolean"
RUN = (
    "doc_id long, filename string, ts timestamp, success boolean, total_time double, ocr_time double, "
    "pii_time double, logo_time double, anonymization_time double, entities_found int, logos_found int, "
    "ocr_confidence double, pii_confidence double, method string, entities_processed int"
)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 501])
def test_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.5, 0.5 + rng.random() * 1e-9, 1.0, 0.0]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = stats.exact_median(df, "v").first()["median"]
    assert got == (statistics.median(values) if values else None)


def test_entity_statistics(spark):
    rows = [(1, "A", "x", 0.8, True), (1, "A", "y", 0.9, True), (2, "B", "x", 1.0, False), (2, "C", "x", 0.6, True)]
    row = stats.entity_statistics(spark.createDataFrame(rows, ENTITY)).first()
    assert (row.total_entities, row.unique_labels, row.sensitive_entities) == (4, 3, 3)
    assert row.mean_confidence == pytest.approx(0.825)
    assert row.std_confidence == pytest.approx(statistics.pstdev([0.8, 0.9, 1.0, 0.6]))
    assert row.median_confidence == pytest.approx(0.85)


def test_empty_input(spark):
    row = stats.entity_statistics(spark.createDataFrame([], ENTITY)).first()
    assert row.total_entities == 0 and row.sensitive_entities == 0 and row.mean_confidence is None
    runs = spark.createDataFrame([], RUN)
    assert stats.processing_statistics(runs).first().success_rate == 0.0
    assert stats.processing_statistics(runs).first().throughput_docs_per_second == 0.0
    assert stats.batch_summary(runs).first().total_documents == 0
    assert stats.request_summary(runs).first().average_processing_time == 0.0
    assert stats.dashboard_summary(runs).first().success_rate == 0.0
    mappings = spark.createDataFrame([], "original string")
    row = stats.anonymization_report(runs, mappings).first()
    assert row.total_entities_anonymized == 0 and not row.anonymization_performed
    assert row.anonymization_methods_used == []


def test_most_common_type_ties_by_name(spark):
    rows = [(1, "B", "x", 0.8, True), (1, "A", "x", 0.8, True), (3, "C", "x", 0.8, True), (3, "C", "x", 0.8, True)]
    runs = spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id long, success boolean")
    out = {r.label: r for r in stats.entity_type_analysis(spark.createDataFrame(rows, ENTITY), runs).collect()}
    assert set(out) == {"A", "B"} and out["A"].most_common and not out["B"].most_common
    assert out["A"].average_entities_per_document == 1.0


def test_deviation_of_close_scores(spark):
    values = [1e8 + x for x in (0.0, 1e-3, 2e-3)]
    rows = spark.createDataFrame([("A", True, v) for v in values], "label string, is_sensitive boolean, confidence double")
    assert abs(stats.entity_statistics(rows).first().std_confidence - 8.165e-4) < 1e-6


def test_large_dimension_is_not_copied(spark):
    from palimpsest.operators import skew

    facts = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7, id % 20) as k")
    dimension = spark.range(15).selectExpr("id as k", "id * 10 as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_dimension(facts, dimension, ["k"])
        assert joined.count() == 500 and "Generate" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_positions_are_cut_by_the_next_column(spark):
    from palimpsest.operators import skew

    rows = spark.range(5000).selectExpr("1 as k", "0.5D as at", "id as seq").repartition(7)
    chunks = skew.ordered_chunks(rows, ["k"], F.col("at"), F.col("seq"))
    assert chunks.select("chunk").distinct().count() > 100
    order = [F.col("at"), F.col("seq")]
    numbered = skew.number_rows(rows, ["k"], order, F.col("at"), "n", 10, F.col("seq"))
    assert numbered.where("n = seq + 1").count() == 5000
