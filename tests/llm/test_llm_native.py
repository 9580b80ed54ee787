"""Operators of DataFrame functions against plain models, and registered SQL."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, line_chunks, mixing, queries

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __extra string, similarity string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "src1", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


WORDS = [f"w{k}" for k in range(40)]


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choices(WORDS, k=n)) for n in (3, 12, 25, 60, 60)]
    texts = [None, "", "a", items[0], items[0].upper() + " tail", items[2]]
    for item in items[1:]:
        for edits in (0, 1, 2, 3):
            words = item.split()
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
            texts.append(" ".join(rng.choices(WORDS, k=30) + words + rng.choices(WORDS, k=30)))
    texts += [items[3], items[3]]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " "), (1, items[1])], "item_id long, text string")

    def shingled(text, k):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            k = min(5, len(item.split()))
            needle, hay = shingled(item, k), shingled(text, k)
            m, best = len(needle), 0
            for a in range(len(hay)):
                window = hay[a : a + m]
                both = sum((Counter(window) & Counter(needle)).values())
                best = max(best, both / (m + len(window) - both))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    docs = docs_of(spark, texts)
    for broadcast in (10**6, 0):
        found = decontaminate.contaminated(docs, bench, broadcast=broadcast).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_needs_no_item_id_and_no_luck(spark):
    rng = random.Random(4)
    items = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(13)) for _ in range(20000)]
    docs = docs_of(spark, [item.rsplit(" ", 1)[0] + " other" for item in items])  # 8 of 10 shingles shared
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    assert found.where("doc_id = item_id and round(similarity, 6) = 0.8").count() == len(items)
    some = docs_of(spark, [items[0], items[1], items[0] + " and " + items[1], "free of them all, every one"])
    unnamed = spark.createDataFrame([(None, items[0]), (None, items[1])], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(some, unnamed).collect()) == [0, 1, 2, 2]
    assert [r.doc_id for r in decontaminate.clean(some, unnamed).collect()] == [3]


def chunked(text):
    import hashlib

    lines = (text or "").split("\n")
    codes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        if (codes[i] + (codes[i - 1] if i else 0) * 131) % (2**31 - 1) % 3 == 0 or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def test_line_chunks(spark):
    rng = random.Random(5)
    passage = [f"line {k} of a passage" for k in range(12)]
    texts = [None, "", "one", "\n".join(passage), "head\n" + "\n".join(passage) + "\ntail", "\n".join(passage[3:]), "\n" * 9, "\n" * 9]
    texts += ["\n".join(rng.choices(passage, k=rng.randrange(1, 30))) for _ in range(20)]
    docs = docs_of(spark, texts)
    seen, want = set(), {}
    for d, text in enumerate(texts):
        kept = []
        for chunk in chunked(text):
            if len(chunk) < 2 or tuple(chunk) not in seen:
                kept.append("\n".join(chunk))
            if len(chunk) >= 2:
                seen.add(tuple(chunk))
        want[d] = "\n".join(kept) if text is not None else None
    got = line_chunks.deduplicated(docs)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert set(docs.columns) <= set(got.columns)
    twice = line_chunks.deduplicated(docs_of(spark, [texts[3], texts[3]], [5, 5])).collect()
    assert [r.text for r in twice] == [texts[3]] * 2  # rows equal in id and text are one document
    none = line_chunks.deduplicated(docs_of(spark, [texts[3], texts[3]], [None, 5])).collect()
    assert {r.doc_id: bool(r.text) for r in none}[5] and line_chunks.deduplicated(docs.limit(0)).count() == 0


def test_short_passages_go_wherever_they_stand(spark):
    rng = random.Random(8)
    passages = [[f"passage {p} line {k}" for k in range(2 + p % 3)] for p in range(6)]
    texts = [None, "", "one", "one", "\n \n"]
    for d in range(60):
        own = lambda: [f"own {d} {rng.random()}" for _ in range(rng.randrange(3))]  # noqa: B023, E731
        gap = rng.choice(["\n", "\n\n", "\n \n\n"])
        texts.append(gap.join([*own(), *rng.choice(passages), f"middle {d}", *rng.choice(passages), *own()]))
    seen, want = set(), {}
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        full = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for a, b in zip(full, full[1:], strict=False):
            if (lines[a], lines[b]) in seen:
                gone |= set(range(a, b + 1))
            seen.add((lines[a], lines[b]))
        want[d] = None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in gone)
    docs = docs_of(spark, texts)
    got = line_chunks.without_passages(docs).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum("passage" in line for t in want.values() for line in (t or "").split("\n")) == sum(map(len, passages))
    left = [r.text for r in line_chunks.deduplicated(docs).collect()]
    assert sum("passage" in line for t in left for line in (t or "").split("\n")) > sum(map(len, passages))  # chunks keep most of them
    twice = line_chunks.without_passages(docs_of(spark, [texts[9], texts[9]], [5, 5])).collect()
    assert twice[0].text == twice[1].text and line_chunks.without_passages(docs.limit(0)).count() == 0


def shares(tree, budget):
    """Water filling of a tree {name: (weight, capacity or tree)}."""
    cap = lambda node: node if isinstance(node, int) else sum(cap(c) for w, c in node.values() if w > 0)
    out, left = {}, budget
    todo = sorted((cap(c) / w, name) for name, (w, c) in tree.items() if w > 0 and cap(c) > 0)
    weights = sum(tree[n][0] for _, n in todo)
    for _, name in todo:
        w, child = tree[name]
        if cap(child) * weights <= left * w:
            out[name], left, weights = cap(child), left - cap(child), weights - w
        else:
            out.update({n: left * tree[n][0] // weights for _, n in todo if n not in out})
            break
    return {n: (q if isinstance(tree[n][1], int) else shares(tree[n][1], q)) for n, q in out.items()}


@pytest.mark.parametrize("budget", [10, 1000, 50_000, 10**7])
def test_budgets_go_to_siblings_before_ancestors(spark, budget):
    rng = random.Random(budget)
    leaves = [(d, la, s, rng.randrange(1, 3000)) for d in "ab" for la in ("de", "en") for s in ("s1", "s2", "s3")]
    weights = [("a", None, None, 5), ("a", "en", None, 3), ("b", "de", "s1", 7), ("b", "en", "s2", 0), ("zz", None, None, 9)]
    own = {w[:3]: w[3] for w in weights}
    tree = defaultdict(lambda: defaultdict(dict))
    for d, la, s, n in leaves:
        tree[d][la][s] = (own.get((d, la, s), 1), n * 2)
    plain = {d: (own.get((d, None, None), 1), {la: (own.get((d, la, None), 1), dict(x)) for la, x in y.items()}) for d, y in tree.items()}
    want = {(d, la, s): q for d, y in shares(plain, budget).items() for la, x in y.items() for s, q in x.items()}
    sizes = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("b", F.lit(budget).cast("long"))
    table = spark.createDataFrame(weights, "domain string, lang string, source string, weight long")
    got = mixing.leaf_budgets(sizes, table, F.col("b"), 2).collect()
    assert {(r.domain, r.lang, r.source): r.quota for r in got if r.quota} == {k: q for k, q in want.items() if q}


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    import hashlib

    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), None, rng.choice(["s1", "s2"]), rng.randrange(0, 50), "keep", "c") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, __id string, copies string")
    weights = spark.createDataFrame([("a", None, None, 3), ("b", "", "s1", 4)], "domain string, lang string, source string, weight long")
    total = sum(r[4] for r in rows)
    taken = mixing.mix(docs, weights, budget_share=1.0, max_epochs=3, seed=4)
    got = {r.doc_id: r.copies for r in taken.collect()}
    tree, leaf = defaultdict(lambda: {"": (1, {})}), defaultdict(list)
    for r in rows:
        leaf[r[1], r[3]].append(r)
    for (d, s), members in leaf.items():
        tree[d][""][1][s] = (4 if (d, s) == ("b", "s1") else 1, 3 * sum(m[4] for m in members))
    quota = shares({d: (3 if d == "a" else 1, t) for d, t in tree.items()}, total)
    want = {}
    for (d, s), members in leaf.items():
        q, n = quota[d][""][s], sum(m[4] for m in members)
        epochs, rest = divmod(q, n)
        at = 0
        for m in sorted(members, key=lambda m: (hashlib.md5(f"4:{epochs}:{m[0]}".encode()).hexdigest(), m[0])):
            want[m[0]] = epochs + (at < rest)
            at += m[4]
    assert got == {k: c for k, c in want.items() if c}
    assert mixing.repeated(taken).count() == sum(got.values())
    assert mixing.mix(docs.limit(0), weights).count() == 0
