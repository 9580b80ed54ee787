import random

import pytest
from pyspark.sql import functions as F

import model
from palimpsest.operators.boxes import (
    class_names,
    classified,
    logo_classes,
    logo_counts,
    ranked,
    redaction_plan,
    region_plan,
    removable,
    removal_plan,
    suppress,
    top_boxes,
)

BOX = "doc_id long, seq int, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int"


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(9)
    rows = []
    for doc in range(12):
        for seq in range(rng.choice([1, 5, 60, 120])):
            x, y = rng.randint(-20, 120), rng.randint(-20, 90)
            w, h = rng.choice([0, 5, 7, 30, 33, 64, 90]), rng.choice([4, 9, 30, 40, 70])
            rows.append((doc, seq, rng.randint(8, 11), rng.choice([0.5, 0.6, 0.7, 0.9, 0.91]), x, y, x + w, y + h))
    # Copies of one box.
    rows += [(0, 1000 + i, 9, 0.66, 5, 5, 50, 50) for i in range(40)]
    return spark.createDataFrame(rows, BOX), rows


@pytest.mark.parametrize(
    "limit, by_class, iou",
    [(2000, True, 0.5), (2000, False, 0.3), (0, True, 0.5), (25, False, 0.3)],
)
def test_suppression(spark, boxes, limit, by_class, iou):
    df, rows = boxes
    got = {(r.doc_id, r.seq) for r in suppress(df, iou, by_class=by_class, limit=limit).collect()}
    want, groups = set(), {}
    for r in rows:
        groups.setdefault((r[0], r[2] if by_class else 0), []).append((r[1], r[3], r[4:]))
    for (doc, _), members in groups.items():
        want |= {(doc, k[0]) for k in model.suppress(members, iou)}
    assert got == want


@pytest.mark.parametrize("limit", [200_000, 0, 50])
def test_ranks(spark, boxes, limit):
    df, rows = boxes
    got = {(r.doc_id, r.seq): r["rank"] for r in ranked(df, limit=limit).collect()}
    for doc in range(12):
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: (-r[3], r[1]))
        assert [got[(doc, r[1])] for r in mine] == list(range(1, len(mine) + 1))


def test_top_boxes_limits_before_the_shuffle(spark, boxes):
    top = top_boxes(boxes[0], k=3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


def test_classes_and_removal(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0.7, -3, 2, 98, 60), (1, 1, 11, 0.9, 0, 0, 5, 5), (2, 0, 9, 0.69, 0, 0, 5, 5)], BOX
    ).withColumn("width", F.lit(100)).withColumn("height", F.lit(61))
    found = classified(df, logo_classes(spark))
    rows = {(r.doc_id, r.seq): r for r in found.collect()}
    assert rows[(1, 1)].class_name == "unknown_11" and not rows[(1, 1)].sensitive
    assert rows[(1, 0)].class_name == "microsoft" and rows[(1, 0)].area == 101 * 58
    gone = removable(found)
    assert [(r.doc_id, r.seq) for r in gone.collect()] == [(1, 0)]
    assert removable(found, selective=False).count() == 2
    pads = {m: removal_plan(gone, F.lit(m)).first() for m in ("inpaint", "replace", "blur", "other")}
    assert tuple(pads["inpaint"][c] for c in ("x1", "y1", "x2", "y2")) == (0, 0, 100, 61)
    assert tuple(pads["blur"][c] for c in ("x1", "y1", "x2", "y2")) == (0, 2, 98, 60)
    assert pads["other"].method == "black_box" and pads["replace"].y1 == 0
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    counts = {r.doc_id: r for r in logo_counts(docs, found).collect()}
    assert (counts[1].logos_found, counts[1].removed_logos) == (2, 1)
    assert (counts[3].logos_found, counts[3].removed_logos, counts[3].logo_confidence) == (0, 0, 0.0)
    assert [r.name for r in class_names(logo_classes(spark)).collect()][:2] == ["microsoft", "google"]


def test_regions_only_where_there_are_entities(spark):
    tokens = spark.createDataFrame(
        [(1, 0, -5, 0, 10, 10, 50, 50), (1, 1, 60, 0, 70, 10, 50, 50), (2, 0, 0, 0, 9, 9, 50, 50)],
        "doc_id long, seq int, x1 int, y1 int, x2 int, y2 int, width int, height int",
    )
    planned = region_plan(tokens, F.lit("sepia"))
    assert {r.method for r in planned.collect()} == {"blur"}
    with_entities = spark.createDataFrame([(1,), (1,)], "doc_id long")
    logos = planned.where("false")
    rows = redaction_plan(planned, with_entities, logos).collect()
    assert [(r.doc_id, r.seq, r.x1) for r in rows] == [(1, 0, 0)]
