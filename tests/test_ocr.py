import random

import pytest
from pyspark.sql import functions as F

import model
from palimpsest.operators.ocr import (
    combined_tokens,
    easyocr_tokens,
    engine_tokens,
    fallback_decision,
    ocr_documents,
    page_text,
    tesseract_tokens,
    two_engines,
)

TOKEN = "doc_id long, seq int, text string, confidence double, x1 int, y1 int, x2 int, y2 int, engine string, language string"


def test_readers(spark):
    raw = spark.createDataFrame(
        [(1, 0, [(1.9, 2.9), (9.9, 2.1), (9.1, 8.8), (1.2, 8.9)], "  hi \n", 0.7), (1, 1, [(0.0, 0.0)], "low", 0.69)],
        "doc_id long, seq int, quad array<struct<x:double,y:double>>, text string, confidence double",
    )
    rows = easyocr_tokens(raw).collect()
    assert [(r.text, r.x1, r.y1, r.x2, r.y2) for r in rows] == [("hi", 1, 2, 9, 8)]
    raw = spark.createDataFrame(
        [(1, 0, " a ", 70, 1, 2, 3, 4), (1, 1, "b", 69, 1, 2, 3, 4), (1, 2, " \t", 99, 1, 2, 3, 4), (1, 3, "c", -1, 0, 0, 0, 0)],
        "doc_id long, seq int, text string, conf int, left_px int, top_px int, width int, height int",
    )
    rows = tesseract_tokens(raw).collect()
    assert [(r.text, r.confidence, r.x2, r.y2) for r in rows] == [("a", 0.7, 4, 6)]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    primary, fallback = [], []
    for doc in range(60):
        for slot, rows in ((0, primary), (1, fallback)):
            for seq in range(rng.choice([0, 1, 5, 40])):
                y, x = rng.randint(0, 12) * 9, rng.randint(0, 6) * 40
                text = f"w{slot}{seq}" if doc % 4 else f"long-word-number-{slot}-{seq}"
                confidence = rng.choice([0.7, 0.8, 0.9, 0.95])
                rows.append((doc, seq, text, confidence, x, y, x + 30, y + rng.choice([8, 9, 30]), "e", "l"))
    docs = spark.createDataFrame([(d,) for d in range(62)], "doc_id long")
    tokens = two_engines(spark.createDataFrame(primary, TOKEN), spark.createDataFrame(fallback, TOKEN))
    return docs, tokens, primary, fallback


def expected(primary, fallback, doc, use_fallback=True):
    own = [t for t in primary if t[0] == doc]
    other = [t for t in fallback if t[0] == doc]
    ask = not own or round(sum(t[3] for t in own) / len(own), 9) < 0.8 or sum(len(t[2]) for t in own) < 50
    if not (use_fallback and ask):
        other = []
    both = own + other
    if own and other:
        both = sorted(both, key=lambda t: -t[3])
    return both


@pytest.mark.parametrize("limit", [200_000, 0, 30])
@pytest.mark.parametrize("use_fallback", [True, False])
def test_page_text(spark, pages, limit, use_fallback):
    docs, tokens, primary, fallback = pages
    rows = page_text(tokens, docs, use_fallback, limit=limit).collect()
    got, counts = {r.doc_id: r.full_text for r in rows}, {r.doc_id: r.tokens for r in rows}
    assert len(rows) == 62  # one row per document whatever its size
    assert set(got) == set(range(62))
    for doc in range(62):
        used = expected(primary, fallback, doc, use_fallback)
        assert got[doc] == model.page_text([(t[5], t[4], t[7], t[2]) for t in used]), doc
        assert counts[doc] == len(used)


@pytest.mark.parametrize("limit", [200_000, 0, 30])
def test_combined_order(spark, pages, limit):
    docs, tokens, primary, fallback = pages
    got = {}
    for r in combined_tokens(tokens, docs, limit=limit).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.confidence))
    for doc in range(60):
        used = expected(primary, fallback, doc)
        assert got.get(doc, []) == [(t[2], t[3]) for t in used], doc


def test_decision_and_unknown_engine(spark, pages):
    docs, tokens, primary, _ = pages
    rows = {r.doc_id: r for r in fallback_decision(tokens, docs).collect()}
    assert rows[61].use_fallback and rows[61].tokens == 0 and rows[61].mean_confidence == 0.0
    assert engine_tokens({}, "easyocr") is None and engine_tokens({"x": docs}, "x") is None
    with pytest.raises(ValueError):
        ocr_documents({}, docs)


def test_threshold_per_document(spark):
    raw = spark.createDataFrame(
        [(1, 0, [(0.0, 0.0), (1.0, 1.0)], "a", 0.75, 0.8), (2, 0, [(0.0, 0.0), (1.0, 1.0)], "b", 0.75, 0.7)],
        "doc_id long, seq int, quad array<struct<x:double,y:double>>, text string, confidence double, cut double",
    )
    assert [r.text for r in easyocr_tokens(raw, F.col("cut")).collect()] == ["b"]
