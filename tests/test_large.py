"""Documents, pages and tables with more rows than one task should hold: the same results by the other way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.checks.streams import QUERIES, delivered
from palimpsest.operators import ordered
from palimpsest.operators.boxes import suppress
from palimpsest.operators.components import components
from palimpsest.operators.ocr import TOKEN, page_text
from palimpsest.operators.rewrite import restored_text
from palimpsest.plans.detection import detect
from palimpsest.plans.documents import process_batch, process_documents
from palimpsest.plans.findings import detect_rows
from palimpsest.sources import sinks
from palimpsest.streaming.streams import run_available, with_engine_rows

RAW = "engine string, raw_label string, start int, end int, score double, word string, seq bigint"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowded(spark):
    """Texts of every size with overlapping engine rows: short ones, some over a whole text, malformed ones."""
    rng = random.Random(5)
    words = "user password of the account bank 10.1.2.3 B-123456 EMP123456 Ämne a@b.example é 😀 server".split()
    docs, ner, groups = [], [], []
    for d in range(12):
        text = " ".join(rng.choices(words, k=[0, 5, 3000][d % 3]))
        docs.append((d, text))
        for k in range([0, 3, 350][d % 3] if d != 4 else 40):
            a = rng.randrange(-2, len(text) + 3)
            size = rng.choice([0, 1, 3, 8, 20, 200, len(text)])
            ner.append((d, rng.choice(["PERSON", "ORG", "NORP"]), a, a + size, k))
            groups.append((d, rng.choice(["PER", "MISC", "XYZ"]), a, a + size, rng.choice([0.85, 0.9, 1.0]), k))
    return spark.createDataFrame(docs, "doc_id long, text string"), {
        "spacy": spark.createDataFrame(ner, "doc_id long, raw_label string, start int, end_pos int, seq long"),
        "transformers": spark.createDataFrame(groups, "doc_id long, entity_group string, start int, end_pos int, score double, seq long"),
    }


@pytest.mark.parametrize("limit, rows", [(30, 100), (0, 10**6)])
def test_findings_of_large_documents_are_those_of_one_row(spark, crowded, limit, rows):
    docs, raw = crowded
    whole = detect(docs, raw_tables=raw)
    by_rows = detect_rows(docs, raw_tables=raw, limit=limit, rows=rows)
    for name in ("findings", "merged", "entities"):
        want = whole.select("doc_id", F.explode(name).alias("f")).select("doc_id", "f.*")
        assert sorted(map(tuple, getattr(by_rows, name).collect())) == sorted(map(tuple, want.collect())), name


def test_a_winner_over_a_whole_text_is_carried_through_every_range(spark):
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")
    rows = [(1, "PER", 0, 5000, 1.0, 0)] + [(1, "PER", k, k + 3, 0.9, k + 1) for k in range(1, 4000)]
    raw = {"transformers": spark.createDataFrame(rows, "doc_id long, entity_group string, start int, end_pos int, score double, seq long")}
    found = detect_rows(docs, engines=("transformers",), raw_tables=raw, recognisers=[], limit=10, rows=200)
    assert [(r.start, r.end) for r in found.entities.collect()] == [(0, 5000)] and found.findings.count() == 4000


def test_long_texts_are_scanned_in_passages(spark, monkeypatch):
    """Of any text: cut behind blanks and line ends, where no pattern looks across; and no scan sees more than a passage of a text that has such places."""
    from palimpsest.plans import findings

    rng = random.Random(11)
    parts = ["456 ", "456B\n", "office ", "Room-101 ", "555 ", "(555) ", "123-4567", "4111 1111 ", "1111 1111 ", "a.b@c.org ", "http://x.y/z ", "EMP123456 ", "SYS-", "ab-12345", "\n", "\t", "\u00a0",
             "é", "\u0301", "😀 ", "password of ", "access ", "the employee, ", "10.1.2.3 ", "id "]
    texts = ["".join(rng.choice(parts) for _ in range(900)) for _ in range(12)] + ["EMP123456-" * 400, "x" * 3000, "1 " * 2000 + "AC-123456", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = {"spacy": spark.createDataFrame([(d, "PERSON", 0, min(len(t), 2500), k) for d, t in enumerate(texts) for k in range(2)], "doc_id long, raw_label string, start int, end_pos int, seq long")}
    want = detect(docs, raw_tables=raw).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*").collect()
    monkeypatch.setattr(findings, "PASSAGE", 100)
    monkeypatch.setattr(findings, "BLOCK_PIECES", 1)
    monkeypatch.setattr(findings, "BLOCK", findings.PIECE)
    got = detect_rows(docs, raw_tables=raw, limit=1, rows=10**6).findings.collect()
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    scan = findings.scan_patterns
    monkeypatch.setattr(findings, "scan_patterns", lambda *a, **b: f"if(length(text) > 1000, raise_error('too long'), {scan(*a, **b)})")
    assert detect_rows(docs.where("doc_id < 12"), raw_tables=raw, limit=1, rows=10**6, context=False).findings.count() > 400


@pytest.mark.parametrize("swept", [50_000, 4_000])
def test_a_long_chain_of_boxes(spark, swept):
    n = 5_000  # each overlaps the next two or so, and each is less sure than the one before
    chain = spark.range(n).selectExpr(
        "1L as doc_id", "cast(id as int) as seq", "0 as class_id", f"1 - id / {n}.0D as confidence", "cast(id * 20 + if(id >= 2500, 500, 0) as int) as x1",
        "0 as y1", "cast(id * 20 + if(id >= 2500, 500, 0) + 100 as int) as x2", "50 as y2",
    )
    kept = {r.seq for r in suppress(chain, limit=10, swept=swept).collect()}
    assert kept == set(range(0, n, 2))  # the chain is broken at 2,500, so no component is larger than that


def test_boxes_of_all_ways_agree(spark):
    rng = random.Random(3)
    rows = []
    for k in range(500):
        x, y, w, h = rng.randrange(-60, 700), rng.randrange(-20, 300), rng.choice([0, 5, 20, 21, 60, 90]), rng.choice([10, 14, 33, 80])
        rows.append((1, k, k % 2, rng.choice([0.5, 0.6, 0.9]), x, y, x + w, y + h))
    boxes = spark.createDataFrame(rows, "doc_id long, seq int, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int")
    want = sorted(map(tuple, suppress(boxes, 0.4).collect()))
    for swept in (10**6, 60):
        assert sorted(map(tuple, suppress(boxes, 0.4, limit=20, swept=swept).collect())) == want


def test_components(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 400)
    edges = [(ids[k], ids[k + 1]) for k in range(300)] + [(ids[350], ids[k]) for k in range(340, 350)] + [(5 * 10**6, 5 * 10**6)]
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    got = {r.node: r.root for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    path, star = min(ids[:301]), min(ids[340:351])
    assert got == {i: path if k <= 300 else star if 340 <= k <= 350 else i for k, i in enumerate(ids)}


def test_equal_positions_are_numbered_range_by_range(spark):
    rows = spark.range(20_000).selectExpr("1 as k", "0.5D as at", "id as seq").repartition(7)
    ranged = ordered.in_ranges(rows, [F.col("k"), F.col("at"), F.col("seq")], rows=1_000)
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 1_000
    assert ordered.in_ranges(rows.withColumn("seq", F.lit(1)), [F.col("at")], rows=1_000).select("range").distinct().count() > 10
    placed = ordered.numbered(rows, ["k"], [F.col("at"), F.col("seq")], "n", rows=1_000)
    assert placed.where("n = seq + 1").count() == 20_000


def test_many_tokens_at_one_position(spark):
    n = 30_000
    one = "5 as x1, 5 as y1, 6 as x2, 6 as y2, 'easyocr' as engine, 'en' as language, 0 as slot"
    tokens = spark.range(n).selectExpr("1L as doc_id", "cast(id as int) as seq", "concat('t', id) as text", "0.9D as confidence", *one.split(", "))
    docs = spark.createDataFrame([(1,)], "doc_id long")
    assert set(TOKEN) < set(tokens.columns)
    (row,) = page_text(tokens.repartition(5), docs, limit=100, rows=2_000).collect()
    assert row.full_text == " ".join(f"t{k}" for k in range(n)) and row.tokens == n


def test_input_order_needs_no_window_over_everything(spark, tmp_path):
    rows = spark.range(5_000).selectExpr("(id * 7919) % 5000 as at", "id").repartition(9)
    placed = sinks.written_in_order(rows, str(tmp_path / "o"), "at")
    assert placed.where("place = at").count() == 5_000 and "Window" not in plan_of(placed)
    assert sinks.written_in_order(rows.limit(0), str(tmp_path / "none"), "at").count() == 0


def test_values_put_back_in_one_pass_are_those_put_back_one_by_one():
    rng = random.Random(1)
    for _ in range(5_000):
        letters = rng.choice(["ab", "abcd", "abcdefghij"])
        word = lambda a, b: "".join(rng.choices(letters, k=rng.randrange(a, b)))  # noqa: B023, E731
        pairs = sorted(((word(0, 5), word(0, 5)) for _ in range(rng.randrange(6))), key=lambda p: -len(p[0]))
        text = "".join(rng.choice([word(0, 6), *(p[0] for p in pairs)]) for _ in range(rng.randrange(8)))
        want = text
        for value, original in pairs:
            want = want.replace(value, original) if value else want
        assert restored_text(text, pairs) == want, (text, pairs)


def test_a_failed_run_saves_nothing(spark, tmp_path):
    docs = process_documents(spark.createDataFrame([(1, "EMP123456", 1.5)], "doc_id long, text string, total_time double")).documents
    path = tmp_path / "batch"
    broken = docs.withColumn("anonymized_text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.save_batch_results(broken, str(path))
    assert not path.exists()
    sinks.save_batch_results(docs, str(path))
    with pytest.raises(FileExistsError):
        sinks.save_batch_results(docs, str(path))
    sinks.save_batch_results(docs.withColumn("doc_id", F.lit(2).cast("long")), str(path), mode="overwrite")
    (row,) = sinks.saved_batch(spark, str(path)).collect()
    assert (row.doc_id, row.successful, row.ocr_confidence, len(row.anonymization_mapping)) == (2, 1, None, 1)


def test_only_touched_parts_of_a_mapping_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "m")
    table = lambda rows: spark.createDataFrame(rows, "original string, anonymized string")
    sinks.upsert_mapping(table([(f"v{k}", "old") for k in range(200)]), path, "run-1", parts=16)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("part-*.parquet")}
    before = files()
    sinks.upsert_mapping(table([("v3", "new"), ("fresh", "x")]), path, "run-2", parts=16)
    assert len({p for p in files() if p not in before}) <= 2 and len(files()) == len(before)
    sinks.upsert_mapping(table([("v3", "stale")]), path, "run-1", parts=16)
    got = {r.original: r.anonymized for r in sinks.stored_mapping(spark, path).collect()}
    assert got["v3"] == "new" and got["fresh"] == "x" and got["v4"] == "old" and len(got) == 201


def test_bucketed_tables_meet_without_a_shuffle(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('mail user', id, '@mail.example.org') as text")
    raw = spark.range(300).selectExpr("id as doc_id", "'PERSON' as raw_label", "0 as start", "4 as end_pos")
    texts, spans = sinks.write_bucketed(docs, "large_texts", buckets=4), sinks.write_bucketed(raw, "large_spans", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = detect(texts, raw_tables={"spacy": spans})
        assert "Exchange" not in plan_of(met.select("doc_id", "entities")) and met.count() == 300
        assert "Exchange" in plan_of(detect(docs, raw_tables={"spacy": raw}).select("doc_id", "entities"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table large_texts")
        spark.sql("drop table large_spans")


def test_a_bucket_is_one_file(spark):
    """However many tasks write a table; and the registered job has as many buckets as a shuffle has partitions."""
    sinks.write_bucketed(spark.range(0, 600, 1, 12).withColumnRenamed("id", "doc_id"), "large_ids", buckets=5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert len(spark.table("large_ids").inputFiles()) == 5
        job = QUERIES["processed_bucketed"](spark, "/root/testdata/sf0.001")
        assert set(re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan_of(job))) == {("3", "3")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sql("drop table large_ids")


def test_several_batches_need_a_key(spark):
    two = spark.createDataFrame([(["a"],), (["b"],)], "texts array<string>")
    with pytest.raises(ValueError, match="batch_key"):
        process_batch(two)


def test_engine_rows_meet_their_documents_on_streams(spark, tmp_path):
    def docs(*rows):
        return spark.createDataFrame(rows, "doc_id long, text string, s long").selectExpr("doc_id", "text", "timestamp_seconds(s) as ts")

    def raw(*rows):
        return spark.createDataFrame([("spacy", "PERSON", 0, 3, None, None, k, d) for k, d in rows], f"{RAW}, doc_id long")

    day = 86_400
    left = delivered([docs((1, "one", day), (2, None, day + 5)), docs((3, "three", 2 * day)), docs((4, "four", 3 * day)), docs((0, "", 90 * day)), docs((0, "", 180 * day))], str(tmp_path / "d"))
    right = delivered([raw((1, 1), (9, 3)), raw((2, 1)), raw((7, 77)), raw((8, 1), (8, 4))], str(tmp_path / "r"))
    out = with_engine_rows(left, right, "1 hour")
    run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("doc_id > 0").collect()
    held = {r.doc_id: (r.text, sorted(x.seq for x in r.raw)) for r in rows if not r.late}
    late = sorted((r.doc_id, x.seq, x.start, x.end) for r in rows if r.late for x in r.raw)
    assert held[2] == ("", []) and held[3] == ("three", [9]) and held[4] == ("four", [8]) and held[1][0] == "one" and 1 in held[1][1]
    assert (77, 7, 0, 3) in late and (1, 8, 0, 3) in late
    assert sorted(held[1][1] + [seq for d, seq, _, _ in late if d == 1]) == [1, 2, 8]  # nothing is lost, whenever it came


def test_documents_of_one_group_are_held_apart(spark, tmp_path):
    docs = spark.range(1, 501).selectExpr("id as doc_id", "concat('text ', id) as text", "timestamp_seconds(86400 * (1 + id % 2)) as ts")
    clock = [spark.sql(f"select -1L as doc_id, '' as text, timestamp_seconds({day * 86_400}) as ts") for day in (90, 180)]
    raw = spark.range(1, 501).selectExpr("'spacy' as engine", "'PERSON' as raw_label", "0 as start", "3 as end", "cast(null as double) as score", "cast(null as string) as word", "id as seq", "id as doc_id")
    left = delivered([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), *clock], str(tmp_path / "d"))
    right = delivered([raw.where("doc_id % 5 > 0"), raw.where("false"), raw.where("false"), raw.where("doc_id % 5 = 0 and doc_id % 2 = 0")], str(tmp_path / "r"))
    out = with_engine_rows(left, right, "1 hour", groups=1)
    run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("doc_id > 0").collect()
    held = {r.doc_id: (r.text, [x.seq for x in r.raw]) for r in rows if not r.late}
    late = sorted((r.doc_id, x.seq) for r in rows if r.late for x in r.raw)
    assert held == {k: (f"text {k}", [k] if k % 5 else []) for k in range(1, 501)}
    assert late == [(k, k) for k in range(10, 501, 10)]


def test_held_documents_are_on_disk_and_in_small_groups(spark, tmp_path, monkeypatch):
    from palimpsest.streaming import streams

    assert streams.groups_for(12_000_000) == 12_000 and streams.groups_for(50) == streams.GROUPS
    monkeypatch.setattr(streams, "GROUP_DOCS", 7)  # handed on in slices
    docs = spark.range(1, 41).selectExpr("id as doc_id", "concat('text ', id) as text", "timestamp_seconds(86400) as ts")
    clock = [spark.sql(f"select -1L as doc_id, '' as text, timestamp_seconds({day * 86_400}) as ts") for day in (90, 180)]
    raw = spark.range(1, 41).selectExpr("'spacy' as engine", "'PERSON' as raw_label", "0 as start", "3 as end", "cast(null as double) as score", "cast(null as string) as word", "id as seq", "id as doc_id")
    out = with_engine_rows(delivered([docs, *clock], str(tmp_path / "d")), delivered([raw], str(tmp_path / "r")), "1 hour", groups=2)
    run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"), streams.STATE_ON_DISK)
    assert all(spark.conf.get(name, None) != value for name, value in streams.STATE_ON_DISK.items())
    assert list((tmp_path / "cp" / "state").rglob("*.zip")) and not list((tmp_path / "cp" / "state").rglob("*.delta"))
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("doc_id > 0").collect()
    assert sorted((r.doc_id, r.late, r.text, [x.seq for x in r.raw]) for r in rows) == [(k, False, f"text {k}", [k]) for k in range(1, 41)]


def test_short_ranges_take_few_partitions(spark):
    from palimpsest.operators.ordered import in_ranges

    rows = spark.range(20_000).selectExpr("(id * 7919) % 20000 div 3 as v", "id")
    ranged = in_ranges(rows, [F.col("v"), F.col("id")], "place", 100)
    got = ranged.orderBy("v", "id").select("place").collect()
    numbers = [r.place for r in got]
    assert len(numbers) == 20_000 and numbers == sorted(numbers)
    assert max(numbers.count(n) for n in set(numbers)) <= 100
    assert len(ranged.inputFiles()) <= 4  # a file for each of 400 ranges before
