"""Operators with Python in tasks against plain models, round trips and held-out accuracy."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import chat, components, induced, packing, quality, simhash, style_tree, suffix, toxicity

PAIR = "doc_id long, text string"


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 70))] + [0]
        sa = induced.suffix_array(np.array(s)).tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        shared = induced.common_prefixes(np.array(s), np.array(sa), 1)
        for a, b in itertools.pairwise(sa):
            n = 0
            while s[a + n] == s[b + n] and s[a + n] > 1:
                n += 1
            assert shared[b] == n


def cut_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    starts = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            starts[t[i : i + length]] = starts.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 0])
def test_repeated_strings_are_cut(spark, hot):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passage = word(300)
    texts = [None, "", "short", passage, passage, word(50) + passage + word(80), passage[40:260] + word(100), "a" * 500, "ab" * 300, word(5000)]
    texts += [word(rng.randrange(10, 200)) + passage[rng.randrange(100) :] + word(60) for _ in range(12)]
    rows = [*enumerate(texts), (None, passage), (3, passage)]
    texts = [t for _, t in rows]
    got = suffix.deduplicated(spark.createDataFrame(rows, PAIR), length=100, gram=16, hot=hot, shard_bytes=2000).collect()
    found = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert found == sorted(cut_by_hand(texts, 100))
    assert suffix.deduplicated(spark.createDataFrame([], PAIR)).count() == 0


def fingerprint_by_hand(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(4)
    words = [f"w{k}É" for k in range(50)]
    texts = [None, "", " \n", "one", "One", "one two three"]
    for _ in range(30):
        base = rng.choices(words, k=300)
        texts += [" ".join(base)] * 2
        for _ in range(3):
            base = [*base]
            base[rng.randrange(300)] = "new"
            texts.append(" ".join(base))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "one"), (9, "one")]
    fps = {t: fingerprint_by_hand(t) for _, t in rows}
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[rows[a][1]] ^ fps[rows[b][1]]).bit_count() <= 4:
            group[find(a)] = find(b)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    want = sorted((str(d), fps[t], first[find(i)]) for i, (d, t) in enumerate(rows))
    docs = spark.createDataFrame(rows, PAIR).withColumn("__fp", F.lit(1))
    for points in (20_000, 10):
        got = simhash.near_duplicates(docs, shard_points=points).collect()
        assert sorted((str(r.doc_id), r.fp % 2**64, r["first"].doc_id) for r in got) == want
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values())) and kept.columns == docs.columns
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_ledger(spark):
    text = "a b c a b c d\nx\nx\n\n" + "é# " * 3
    row = quality.ledger(spark.createDataFrame([(1, text), (2, None), (3, "")], PAIR)).orderBy("doc_id").collect()
    one = row[0]
    assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (12, 15, 3, 1, 6 + 0)
    assert row[1].n_words == row[2].n_words == 0 and row[1].failed & 1
    clean = " ".join(f"word{k}" for k in range(80))
    entries = quality.ledger(spark.createDataFrame([(1, clean), (2, "x " * 90), (3, clean.replace(" ", "!! "))], PAIR))
    assert {r.doc_id: r.kept for r in quality.apply_policy(entries, "v2").collect()} == {1: True, 2: False, 3: False}
    assert {r.doc_id: r.kept for r in quality.apply_policy(entries, "v1").collect()}[3]
    marks = {r.rule: r for r in quality.ablation(entries, "v2").collect()}["marks"]
    assert (marks.failed, marks.failed_alone, marks.kept_without) == (1, 1, 2)


def cost_by_force(codes, options):
    best = {chat.START: 0.0}
    for code in codes:
        now = {}
        for cost, before, after, _, _ in options[code]:
            if before in best:
                now[after] = min(now.get(after, 1e9), best[before] + cost)
        best = now
    return min(c for s, c in best.items() if chat.FINAL[s])


def test_chat_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(6)
    names = ["system", "user", "assistant", "tool", None, " User "]
    rows = [(c, t, rng.choice(names), f"t{c}-{t}") for c in range(25) for t in range(rng.randrange(1, 15))]
    rows += [(None, 1, "user", None), (3, None, "user", "first"), (50, 0, "user", "hot")] + [(50, k, "user", "hot") for k in range(30)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "piece").collect()
    options = chat._options(chat.COSTS)
    code = lambda r: chat.ROLES.index(r.strip().lower()) if r and r.strip().lower() in chat.ROLES else chat.OTHER
    for conv in {r[0] for r in rows}:
        pieces = [p for p in out if p.conv_id == conv]
        mine = [p for p in pieces if p.action != "inserted"]
        given = [r for r in rows if r[0] == conv]
        assert len(mine) == len(given) and [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
        roles = [p.role for p in pieces if p.action != "merge"]
        state = chat.START
        for role in roles:
            assert chat.LEGAL[state, chat.ROLES.index(role)]
            state = chat.ROLES.index(role)
        assert chat.FINAL[state]
        paid = 0.0
        for p in pieces:
            paid += chat.COSTS["insert"] * (p.action == "inserted")
            paid += chat.COSTS["system_merge" if p.role == "system" else "merge"] * (p.action == "merge")
            if p.action != "inserted" and code(p.given_role) not in (chat.OTHER, chat.ROLES.index(p.role)):
                paid += chat.COSTS["relabel"]
        assert paid == cost_by_force([code(p.given_role) for p in mine], options)
        text = "".join(p.rendered for p in pieces)
        assert text.count("<|end|>") == len(roles) and text.count("<|user|>") == roles.count("user")
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_best_fit():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 33) for _ in range(300)]
    rows = packing.best_fit(lengths, 32)
    assert sorted(p for row in rows for p in row) == list(range(300)) and all(sum(lengths[p] for p in row) <= 32 for row in rows)
    room = []  # the same by trying all rows
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        room.remove(min(fits)) if fits else None
        room.append((min(fits) if fits else 32) - n)
    assert len(room) == len(rows)


@pytest.mark.parametrize("kind", ["uint16", "uint32"])
def test_packed_tokens_give_the_texts_back(spark, kind):
    rng = random.Random(9)
    texts = [None, "", "a", "é  b\n c\t", "x" * 3000, "word " * 900, "word " * 900] + [" ".join(rng.choices(["the", "ñandú", "of"], k=rng.randrange(200))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "none")], PAIR).repartition(3)
    packed = packing.pack(docs, row_tokens=64, pool_tokens=700, kind=kind).cache()
    for row in packed.collect():
        ids, places = np.frombuffer(row.ids, f"<{kind[0]}{int(kind[4:]) // 8}"), np.frombuffer(row.positions, f"<{kind[0]}{int(kind[4:]) // 8}")
        assert len(ids) == len(places) == 64 and row.cu_seqlens[0] == 0 and (ids[row.cu_seqlens[-1] :] == packing.END).all()
        for a, b in itertools.pairwise(row.cu_seqlens):
            assert places[a:b].tolist() == list(range(b - a))
    coder = packing.coding(packing.ranks())
    pieces = {}
    for r in packing.unpack(packed, kind).collect():
        pieces.setdefault((r.doc_id, r.doc_number), {})[r.doc_offset] = r.ids
    back = sorted((str(d), coder.decode([i for _, p in sorted(x.items()) for i in p][:-1])) for (d, _), x in pieces.items())
    assert back == sorted((str(d), t or "") for d, t in [*enumerate(texts), (None, "none")])
    assert packed.select("pack_id").distinct().count() == packed.count()
    assert packing.pack(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).withColumn("held", toxicity.held_out()).join(labels, "doc_id").where("held").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert bad and np.mean([b > g for b in bad for g in good]) > 0.85
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(good)
    odd = spark.createDataFrame([(None, None, 3.0), (1, "", 2.0)], "doc_id long, text string, score double")
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, model).collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd, none).collect()} == {0.0} and toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 1")).share == 1.0


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.2
    speak = lambda hit, miss: rng.random(4000) < np.where(truth, hit, miss)
    base = speak(0.6, 0.02)
    votes = np.column_stack([base, base, base, speak(0.7, 0.05), speak(0.3, 0.3), truth & (rng.random(4000) < 0.95)]).astype(float)
    post, rates, weight = toxicity.label_model(votes, votes[:, -1])
    assert ((post > 0.5) == truth).mean() > 0.985
    assert weight[0] < 0.5 < weight[3] and abs(rates[1, 3] - 0.7) < 0.1 and abs(rates[1, 4] - rates[0, 4]) < 0.1


def text_of(page):
    blocks, _ = style_tree.parse(page)
    inside = [b for b in blocks if b.main] or blocks
    return [b.text for b in inside]


def test_pages_are_parsed_like_browsers_do():
    assert text_of("<body><div>a &amp; b<br>c</div><p>x<p><b>y<br><p>z <i>k</i>l</p>tail<ul><li>1<li>2</ul>") == ["a & b c", "x", "y", "z kl", "tail", "1", "2"]
    page = """<header>Site</header><article><header><h1>T</h1></header><p class=lead>a &lt;b&gt; 3 < 4</p><div class="share-box">S</div><aside>n</aside>
      <form>f<input></form><script>var t="</p>";</script><section id="comments"><p>c</p></section></article><p>out</p><!-- x --><footer>f</footer>"""
    assert text_of(page) == ["T", "a <b> 3 < 4"]
    assert text_of("<div class=no-sidebar><article>a</article><article class='comment odd'>c</article></div>") == ["a"]
    assert text_of("") == [] and text_of("plain") == ["plain"] and text_of("<a title='x>y'>t</a>") == ["t"]
    assert text_of("<div hidden>h</div><div style='display: none'>h</div><div class='ad'>h</div><div class='headline'>k</div>") == ["k"]


def test_low_branches_are_removed_per_host(spark):
    page = lambda k: f"<body><div class=top>Welcome to the site</div><div class=story><p>Story {k} of many</p><p>More {k * 7}</p></div></body>"
    rows = [(k, "https://www.a.org/x", page(k), "old", "q") for k in range(8)] + [(50, "http://b.org", page(1), "old", "q"), (51, None, None, "old", "q"), (52, "::", "", "old", "q")]
    article = lambda k: f"<article><p>Same</p><div class=note>Read our terms</div><p>{f'Part {k} of a story. ' * 4}</p></article>"
    rows += [(100 + k, "https://c.org", article(k), "old", "q") for k in range(8)] + [(200 + k, "https://d.org", article(0), "old", "q") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, __host0 string")
    got = {r.page_id: r for r in style_tree.main_text(pages).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[3].text == "Story 3 of many\n\nMore 21" and got[50].text.startswith("Welcome") and got[51].text == got[52].text == ""
    assert got[101].text == "Same\n\n" + "Part 1 of a story. " * 3 + "Part 1 of a story."  # a branch that is the same on all pages, beside text that isn't
    assert got[203].text.startswith("Same\n\nRead our terms\n\nPart 0")  # a host of copies keeps its articles
    assert style_tree.main_text(pages.limit(0)).count() == 0


def tree_texts(spark, pages):
    """Extracted text of each (host, page)."""
    rows = [(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(pages)]
    got = style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_copies_do_not_empty_other_pages(spark):
    page = lambda k: "<html><body><div class=top>Welcome</div><div class=story>" + "".join(f"<p>Part {j} of story {k}, told at length</p>" for j in range(8)) + "</div></body></html>"
    stamped = lambda k: page(0).replace("</body>", f"<div class=stamp>{k}</div></body>")
    got = tree_texts(spark, [("copies.org", page(0))] * 1000 + [("copies.org", page(k)) for k in range(1, 21)] + [("near.org", stamped(k)) for k in range(1000)] + [("near.org", page(k)) for k in range(1, 21)])
    assert len(set(got[:1000])) == 1 and "Part 7 of story 0" in got[0]
    for k in range(1, 21):
        assert got[999 + k].startswith("Part 0") and got[999 + k].endswith(f"Part 7 of story {k}, told at length")
        assert f"Part 7 of story {k}, told" in got[2019 + k]  # near copies: the whole page is low, so it stays
    assert all("Part 7 of story 0" in t for t in got[1020:2020])


def test_lists_that_are_the_same_on_every_page_go(spark):
    menu = "<ul>" + "".join(f"<li>Choice {j}</li>" for j in range(20)) + "</ul>"
    page = lambda k: f"<body>{menu}<div class=story><p>Story {k}, which is longer</p>{f'<p>and different {k} </p>' * 20}</div><div class=end>Made by us</div></body>"
    inside = lambda k: f"<article><h4>Read this first</h4>{f'<p>Story {k} is different</p>' * 3}<blockquote>Our terms</blockquote></article>"
    got = tree_texts(spark, [("menu.org", page(k)) for k in range(12)] + [("inside.org", inside(k)) for k in range(12)])
    assert all(t.startswith(f"Story {k}, which") and t.endswith(f"and different {k}") for k, t in enumerate(got[:12]))
    assert got[12:] == ["\n\n".join([f"Story {k} is different"] * 3) for k in range(12)]


@pytest.mark.parametrize("name", ["overflow-hidden", "content sidebar-right", "search-results", "share-price", "sidebar-right", "search"])
def test_names_do_not_remove_the_whole_text(name):
    assert text_of(f"<body><div class='menu'>m</div><div class='{name}'><p>The text</p><p>goes on</p></div><p>end</p></body>") == ["The text", "goes on", "end"]
    assert text_of(f"<body><div class='{name}'><p>x</p><article>a<div class='ad-box'>b</div></article></div></body>") == ["a"]


def test_names_still_remove_what_is_beside_the_text():
    noise = "".join(f"<div class='{n}'>n</div>" for n in ("main-menu", "sidebar-left", "search-form", "share-box", "related-posts", "site-header", "ad1", "cookie-notice"))
    assert text_of(f"<body>{noise}<p>The text of the page</p></body>") == ["The text of the page"]
    assert text_of("<p>Text</p><div id='comments'><article>longer than the text</article></div>") == ["Text"]
    assert text_of("<p>Text</p><div class='comment-list'>longer than the text</div>") == ["Text"]
