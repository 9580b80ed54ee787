import hashlib
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.text import rewritten, safe_file_name
from palimpsest.operators.rewrite import (
    anonymize,
    combined_mapping,
    mapping,
    originals,
    restore_by_mapping,
    restore_by_offsets,
)
from palimpsest.operators.rules import MaskingRule, apply_rule_table, apply_rules
from palimpsest.operators.scan import FINDING, explode_findings
from palimpsest.plans.detection import detect


def one(spark, text, strategy, label="X", preserve="true", names="true", salt="palimpsest"):
    df = spark.createDataFrame([(text, label)], "t string, l string")
    sql = rewritten("t", "l", f"'{strategy}'", preserve, names, salt)
    return df.select(F.expr(sql).alias("r")).first().r


@pytest.mark.parametrize(
    "text, strategy, expected",
    [
        ("ab", "mask", "**"), ("abc", "mask", "a*c"), ("", "mask", ""), ("é😀ü", "mask", "é*ü"),
        ("abcd", "replace_partial", "****"), ("abcde", "replace_partial", "ab*de"),
        ("abc", "replace", "[X]"), ("abc", "nothing", "[X]"),
        ("no at sign", "replace_domain", "no at sign"),
        ("abc", "hash", hashlib.sha256(b"abc").hexdigest()[:16]),
        ("Aé\n€", "encrypt", "ENC_41e90a20ac"), ("", "encrypt", "ENC_"),
        ("abc", "replace_realistic", "[X]"),
    ],
)
def test_fixed_strategies(spark, text, strategy, expected):
    assert one(spark, text, strategy) == expected


def test_drawn_strategies(spark):
    assert re.fullmatch(r"[A-Z]\d-[a-z]{2}_", one(spark, "Q7-eé_", "replace_format"))
    assert one(spark, "Q7-e", "replace_format", preserve="false") == "[X]"
    first, last = one(spark, "Ann Lee", "replace_realistic", "PERSON").split(" ")
    assert first in C.FIRST_NAMES and last in C.LAST_NAMES
    assert one(spark, "Firm", "replace_realistic", "ORGANIZATION") in C.COMPANIES
    assert one(spark, "Ann Lee", "replace_realistic", "PERSON", names="false") == "[PERSON]"
    local, domain = one(spark, "jo.1@a@b.c", "replace_domain").split("@")
    assert local == "xx.0" and domain in C.DOMAINS
    parts = one(spark, "1.2.3.4", "replace_network").split(".")
    assert parts[:2] == ["192", "168"] and all(0 <= int(p) < 255 for p in parts[2:])


def test_draws_repeat_and_depend_on_the_salt(spark):
    values = {one(spark, "EMP123456", "replace_format", salt=s) for s in ("a", "a", "b", "c")}
    assert len(values) == 3


TEXT = "Ann EMP123456, é B-445566 and EMP123456 at 10.0.0.1."


def done(spark, text=TEXT, **options):
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "")], "doc_id long, text string")
    return anonymize(detect(docs, engines=("custom_patterns",)), **options)


def test_text_is_rewritten_and_restored(spark):
    rows = done(spark, strategy="replace").orderBy("doc_id").collect()
    assert rows[0].anonymized_text == "Ann [EMPLOYEE_ID], é [BADGE_NUMBER] and [EMPLOYEE_ID] at [IP_ADDRESS]."
    assert (rows[0].entities_processed, rows[1].anonymized_text, rows[2].anonymized_text) == (4, "nothing here", "")
    for strategy in ("auto", "mask", "hash", "replace", "encrypt"):
        out = done(spark, strategy=strategy).select(
            "text", F.expr(restore_by_offsets("anonymized_text", "replacements")).alias("back")
        )
        assert all(r.text == r.back for r in out.collect())


def test_many_entities_in_one_text(spark):
    text = " ".join(f"EMP{i:06d}x EMP{i:06d}" for i in range(900))
    out = done(spark, text, strategy="hash").select(
        "text", "anonymized_text", F.expr(restore_by_offsets("anonymized_text", "replacements")).alias("back")
    ).first()
    expected = re.sub(
        r"\bEMP\d{6}\b", lambda m: hashlib.sha256(m.group().encode()).hexdigest()[:16], text
    )
    assert out.anonymized_text == expected and out.back == text


def test_overlapping_entities_give_no_text(spark):
    rows = [(1, "abcdef", [(0, 0, 0, 4, "L", "abcd", 0.9, "x", 0.0, True), (2, 0, 0, 6, "L", "cdef", 0.9, "x", 0.0, True)])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, entities array<{FINDING}>")
    row = anonymize(df).first()
    assert row.anonymized_text is None and row.success is False and row.entities_processed == 0


def test_mapping_and_reversal(spark):
    out = done(spark, strategy="replace")
    rows = {r.original: r for r in mapping(out).collect()}
    assert set(rows) == {"EMP123456", "B-445566", "10.0.0.1"}
    assert rows["EMP123456"].first_start == 4 and rows["EMP123456"].last_start == 30
    back = {r.doc_id: r for r in restore_by_mapping(out, mapping(out)).collect()}
    assert back[1].restored_text == TEXT and back[1].is_reversible
    assert back[2].restored_text == "nothing here"
    clash = done(spark, "B-445566 B-777777", strategy="replace")
    row = restore_by_mapping(clash, mapping(clash)).where("doc_id = 1").first()
    assert not row.is_reversible


def test_later_document_wins_in_the_combined_mapping(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (1, "b", "z")], "doc_id long, original string, anonymized string")
    assert {r.original: r.anonymized for r in combined_mapping(rows).collect()} == {"a": "y", "b": "z"}


def test_rules_in_row_and_by_table_agree(spark):
    rules = [
        MaskingRule("ACCESS_CARD", "skip"),
        MaskingRule("EMPLOYEE_ID", "whitelist", values=("EMP123456",)),
        MaskingRule("BADGE_NUMBER", "blacklist", values=("B-445566",)),
        MaskingRule("IP_ADDRESS", "lower_threshold", 0.99),
        MaskingRule("ROOM_NUMBER", "skip"),
        MaskingRule("ROOM_NUMBER", "other"),
    ]
    docs = spark.createDataFrame([(1, TEXT + " CARD-12345 ROOM-101 B-111111 EMP999999")], "doc_id long, text string")
    found = detect(docs, engines=("custom_patterns",))
    own = explode_findings(found.withColumn("r", F.expr(apply_rules("entities", rules))), "r", arrival=False)
    assert [(r.label, r.text) for r in own.orderBy("seq").collect()] == [
        ("BADGE_NUMBER", "B-445566"), ("ROOM_NUMBER", "ROOM-101"), ("BADGE_NUMBER", "B-111111"), ("EMPLOYEE_ID", "EMP999999"),
    ]
    table = spark.createDataFrame(
        [(i, r.entity_type, r.strategy, r.min_confidence, list(r.values)) for i, r in enumerate(rules)],
        "ordinal int, entity_type string, strategy string, min_confidence double, values array<string>",
    )
    long = explode_findings(found, "entities", arrival=False).drop("seq")
    by_table = {(r.start, r.confidence) for r in apply_rule_table(long, table).collect()}
    assert by_table == {(r.start, r.confidence) for r in own.collect()}
    assert own.where("text = 'B-445566'").first().confidence == 1.0


@pytest.mark.parametrize("name, safe", [("../../etc/passwd", "etc_passwd"), ("My cool movie.mov", "My_cool_movie.mov"), ("i contain ümläuts.txt", "i_contain_mluts.txt"), ("..", "")])
def test_safe_file_names(spark, name, safe):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(F.expr(safe_file_name("n")).alias("s")).first().s == safe


def test_plain_values_are_encoded_by_their_bytes(spark):
    plain = "".join(map(chr, range(128)))
    for text in (plain, plain + "é"):
        assert one(spark, text, "encrypt") == "ENC_" + "".join(f"{ord(c):02x}" for c in text)


def test_originals_are_those_of_the_mapping(spark):
    docs = spark.createDataFrame([(1, "EMP123456, EMP123456 and B-123456"), (2, "nothing"), (3, "B-123456")], "doc_id long, text string")
    found = detect(docs)
    want = {(r.doc_id, r.original) for r in mapping(anonymize(found)).collect()}
    rows = [(r.doc_id, r.original) for r in originals(found).collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "replace_format" not in originals(found)._jdf.queryExecution().optimizedPlan().toString()
