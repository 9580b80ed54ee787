import random

import pytest
from pyspark.sql import functions as F

import model
from palimpsest.functions import constants as C
from palimpsest.operators.fuse import merge_overlaps, with_context
from palimpsest.operators.scan import FINDING
from palimpsest.plans.detection import detect


def merged(spark, cases):
    rows = [
        (i, [(s, 0, n, e, "L", "t", c, "x", 0.0, True) for n, (s, e, c) in enumerate(case)])
        for i, case in enumerate(cases)
    ]
    df = spark.createDataFrame(rows, f"id int, f array<{FINDING}>")
    out = df.select("id", F.expr(merge_overlaps("f")).alias("m")).collect()
    return {r.id: [(f.start, f.end, f.confidence, f.rule_no) for f in r.m] for r in out}


CASES = [
    ([(0, 8, 0.8), (5, 12, 0.9), (10, 11, 0.7), (12, 15, 0.7)], [(5, 12, 0.9), (12, 15, 0.7)]),
    ([(0, 5, 0.8), (0, 9, 0.8)], [(0, 9, 0.8)]),
    ([(0, 9, 0.8), (0, 9, 0.8)], [(0, 9, 0.8)]),
    ([(0, 5, 0.9), (5, 8, 0.8)], [(0, 5, 0.9), (5, 8, 0.8)]),
    ([(0, 9, 0.8), (3, 6, 0.95), (7, 9, 0.7)], [(3, 6, 0.95), (7, 9, 0.7)]),
    ([], []),
]


def test_hand_cases(spark):
    got = merged(spark, [c for c, _ in CASES])
    for i, (_, expected) in enumerate(CASES):
        assert [g[:3] for g in got[i]] == expected
    assert got[2][0][3] == 0


def test_random_cases(spark):
    rng = random.Random(3)
    cases = []
    for size in [rng.randint(0, 30) for _ in range(300)] + [255, 256, 257, 700, 1500]:
        case = []
        for _ in range(size):
            start = rng.randint(0, max(10, size * 4))
            case.append((start, start + rng.randint(1, 12), rng.choice([0.7, 0.8, 0.85, 0.9])))
        cases.append(case)
    got = merged(spark, cases)
    for i, case in enumerate(cases):
        spans = [(s, e, c, n) for n, (s, e, c) in enumerate(case)]
        assert got[i] == model.merge(spans)
        ends = [g[1] for g in got[i]]
        assert all(a <= g[0] for a, g in zip(ends, got[i][1:]))


@pytest.mark.parametrize("label", ["PERSON", "SSN", "EMPLOYEE_ID", "IP_ADDRESS", "BADGE_NUMBER", "URL"])
def test_context(spark, label):
    rng = random.Random(label)
    words = sorted({w for ws in C.CONTEXT_KEYWORDS.values() for w in ws}) + ["lorem", "DESCRIPTION", "É"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + "x" * 9 for _ in range(80)]
    rows = []
    for i, text in enumerate(texts):
        start = rng.randint(0, len(text) - 9)
        rows.append((i, text, [(start, 0, 0, start + 9, label, text[start : start + 9], 0.85, "x", 0.0, True)]))
    df = spark.createDataFrame(rows, f"id int, text string, f array<{FINDING}>")
    got = {r.id: r.s[0] for r in df.select("id", F.expr(with_context("f")).alias("s")).collect()}
    for i, text, spans in rows:
        expected = model.boost(text, label, spans[0][0], spans[0][3])
        assert got[i].context_score == expected
        assert got[i].confidence == min(0.85 + expected, 1.0)


def test_policy_number_beats_the_id_inside_it(spark):
    docs = spark.createDataFrame([(1, "see POL-SEC-2024 please")], "doc_id long, text string")
    row = detect(docs, engines=("custom_patterns",)).first()
    assert [(e.label, e.text) for e in row.entities] == [("POLICY_NUMBER", "POL-SEC-2024")]
    assert row.analysis.total_entities_found == 2 and row.analysis.entities_after_merge == 1


def test_threshold_comes_after_the_merge(spark):
    docs = spark.createDataFrame([(1, "SEC-2024"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in detect(docs, engines=("custom_patterns",), threshold=0.99).collect()}
    assert rows[1].analysis.entities_after_merge == 1 and rows[1].entities == []
    assert rows[2].analysis.average_confidence == 0.0 and rows[2].engine_confidence == {}
    assert rows[3].entities == []
