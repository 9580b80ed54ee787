import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import is_title_case
from palimpsest.operators.engines import rejected_rows, union_raw
from palimpsest.operators.scan import explode_findings
from palimpsest.plans.detection import detect

TEXTS = ["John Smith", "john smith", "John SMITH", "McDonald", "O'Neil", "É Été", "It", "3Com", "x", "", "123", "John's", "ÉTÉ", "ǅungla", "Ab1Cd"]


def test_title_case_is_that_of_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.x for r in df.select("t", F.expr(is_title_case("t")).alias("x")).collect()}
    assert got == {t: t.istitle() for t in TEXTS}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(
        [(1, "Employee John Smith (ID: EMP123456) of Acme, It paid 5"), (2, "nothing"), (3, "id ID id EMP000001")],
        "doc_id long, text string",
    )
    ner = spark.createDataFrame(
        [(1, "PERSON", 9, 19), (1, "ORG", 39, 43), (1, "ORG", 45, 47), (1, "NORP", 0, 8), (1, "CARDINAL", 53, 54),
         (1, "PERSON", -1, 3), (1, "PERSON", 5, 5), (1, "PERSON", 50, 500), (9, "PERSON", 0, 1), (1, None, 0, 2), (1, "GPE", None, 2)],
        "doc_id long, raw_label string, start int, end_pos int",
    )
    transformer = spark.createDataFrame(
        [(1, "per", 9, 19, 0.99), (1, "ORG", 39, 43, 0.79), (1, "XYZ", 0, 8, 0.8), (1, "LOC", 0, 8, None)],
        "doc_id long, entity_group string, start int, end_pos int, score double",
    )
    analyzer = spark.createDataFrame(
        [(1, "PERSON", 9, 13, 0.1), (3, "EMPLOYEE_CODE", 9, 18, 0.85)] + [(3, "EMPLOYEE_CODE", 9, 18, 0.7)] * 3,
        "doc_id long, entity_type string, start int, end_pos int, score double",
    )
    return docs, {"spacy": ner, "transformers": transformer, "presidio": analyzer}


def test_adapters(spark, tables):
    docs, raw = tables
    rows = explode_findings(detect(docs, raw_tables=raw, recognisers=[]), "findings").where("doc_id = 1").collect()
    got = {(r.engine, r.label, r.text, round(r.confidence, 6), r.is_sensitive) for r in rows}
    assert got == {
        ("presidio", "PERSON", "John", 0.1, True),
        ("spacy", "PERSON", "John Smith", 0.85, True),
        ("spacy", "ORGANIZATION", "Acme", 0.85, True),
        ("transformer", "PERSON", "John Smith", 0.99, True),
        ("transformer", "XYZ", "Employee", 0.8, False),
    }


def test_malformed_rows(spark, tables):
    docs, raw = tables
    rows = rejected_rows(union_raw(raw), docs).collect()
    assert sorted(r.reason for r in rows) == [
        "empty span", "end after text", "no label", "no offsets", "no score", "start before text", "unknown document",
    ]


def test_all_rows_of_a_document_are_findings(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met Bo")], "doc_id long, text string")
    raw = spark.range(3000).selectExpr("1L as doc_id", "'PERSON' as raw_label", "int(id % 8) as start", "int(id % 8) + 3 as end_pos")
    row = detect(docs, engines=("spacy",), raw_tables={"spacy": raw}).first()
    assert len(row.findings) == row.analysis.total_entities_found == 3000


def test_engines_without_source_are_not_used(spark, tables):
    docs, raw = tables
    row = detect(docs, engines=("spacy", "transformers"), raw_tables={"spacy": raw["spacy"]}).first()
    assert row.engines_used == ["spacy"]


def test_only_the_external_tables_are_shuffled_with_the_text_once(spark, tables):
    docs, raw = tables
    # Keep Spark from broadcasting the tiny tables, as it would not at scale.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = detect(docs, raw_tables=raw)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
