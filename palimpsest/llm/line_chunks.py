"""Line deduplication over content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides where a chunk ends, so a boundary depends on the
lines beside it alone, and inserted lines move no boundary further on. Chunks of two lines or more that
occur again anywhere are removed, but for the first one (by document id, then place). Chunks are grouped by
hash and whole text, so only equal bytes are ever called equal.

Everything is built from DataFrame functions: one shuffle of the chunks, counted before it in each task, one
of light rows (document, place, hash) and one of the texts that are cut.

``without_passages`` removes repeated passages wherever they stand: a chunk's ends depend on the lines around a passage, so
passages of a few lines mostly stay in chunks. It compares every two neighbouring lines (blank ones left out), and all but the first
place of a pair goes, with the blank lines between. The first place of every line stays. Lines repeated alone stay.

Defined results: null texts are empty and stay null; lines end at \\n only; rows equal in id and text are one document, so
all get the same result; rows without an id come last; texts that nothing is cut from stay as they are; a text that is
removed whole becomes empty; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import KEY, document_key, own_names, whole

#: Factor, modulus and divisor of the rolling hash: one boundary in DIVISOR lines.
FACTOR, MODULUS, DIVISOR = 131, 2**31 - 1, 3
LEAST_LINES = 2


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), 0)


def _ends(hashes: Column) -> Column:
    """Numbers (from 1) of the lines that end a chunk."""
    rolling = lambda i: (F.get(hashes, i - 1) + F.coalesce(F.get(hashes, i - 2), F.lit(0)) * FACTOR) % MODULUS
    return F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (rolling(i) % DIVISOR == 0) | (i == F.size(hashes)))


def _cut_up(lines: Column, ends: Column) -> Column:
    def chunk(end: Column, k: Column) -> Column:
        before = F.coalesce(F.get(ends, k - 1), F.lit(0))
        return F.struct((before + 1).alias("line"), (end - before).alias("lines"), F.array_join(F.slice(lines, before + 1, end - before), "\n").alias("text"))

    return F.transform(ends, chunk)


def chunks_of(text: str) -> Column:
    """An array of first line (from 1), number of lines and text of each chunk."""
    hashes = lambda lines: F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint"))
    return _let(F.split(whole(text), "\n", -1), lambda lines: _let(_let(hashes(lines), _ends), lambda ends: _cut_up(lines, ends)))


def repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The occurrences to remove: document key and ``line``, the first line of the chunk."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *document_key(doc_id, text), F.col(text).alias("__text"))
    chunks = keyed.select("doc_id", *KEY, F.explode(chunks_of("__text")).alias("c")).where(F.col("c.lines") >= LEAST_LINES)
    ident = [F.xxhash64("c.text").alias("h1"), F.xxhash64(F.lit(7), "c.text").alias("h2")]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", F.col("c.line").alias("line"))
    texts = chunks.groupBy(*ident, F.col("c.text").alias("text")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # a hash that two different texts share is left alone
    known = texts.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("first").alias("first")).where("texts = 1 and n > 1")
    spots = chunks.select("doc_id", *KEY, F.col("c.line").alias("line"), *ident)
    again = spots.join(known.select("h1", "h2", "first"), ["h1", "h2"])
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.__hash") == F.col("__hash")) & (F.col("first.line") == F.col("line"))
    return again.where(~same).select(*KEY, "line").distinct()


@own_names()
def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``; ``n_removed_chunks`` and ``n_removed_lines`` are added."""
    gone = repeated_chunks(docs, text, doc_id).groupBy(KEY).agg(F.collect_set("line").alias("__gone"))  # at most the lines of a text
    columns = [c for c in docs.columns if c not in ("n_removed_chunks", "n_removed_lines")]
    joined = docs.select(*columns, *document_key(doc_id, text)).join(gone, KEY, "left")
    listed = lambda c: F.array_contains("__gone", c["line"])
    parts = lambda chunks: F.struct(
        F.array_join(F.transform(F.filter(chunks, lambda c: ~listed(c)), lambda c: c["text"]), "\n").alias("kept"),
        F.aggregate(F.filter(chunks, listed), F.lit(0), lambda n, c: n + c["lines"]).cast("long").alias("lines"),
    )
    cut = joined.where("__gone is not null").withColumn("__cut", _let(chunks_of(text), parts))
    cut = cut.select("*", F.col("__cut.kept").alias("__kept"), F.size("__gone").cast("long").alias("n_removed_chunks"), F.col("__cut.lines").alias("n_removed_lines"))
    plain = joined.where("__gone is null").select(*columns, F.lit(0).cast("long").alias("n_removed_chunks"), F.lit(0).cast("long").alias("n_removed_lines"))
    return plain.unionByName(cut.select(*(F.col("__kept").alias(text) if c == text else F.col(c) for c in columns), "n_removed_chunks", "n_removed_lines"))


def pairs_of(text: str) -> Column:
    """An array of the pairs of neighbouring lines that aren't blank: numbers (from 1) and hashes of both."""
    numbered = lambda lines: F.filter(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), F.xxhash64(line).alias("h"), line.rlike(r"[^\x20\x09-\x0D]").alias("full"))), lambda x: x["full"]
    )
    paired = lambda full: F.transform(
        F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))),
        lambda a, k: F.struct(a["line"].alias("line"), F.get(full, k + 1)["line"].alias("until"), a["h"].alias("h1"), F.get(full, k + 1)["h"].alias("h2")),
    )
    return _let(F.split(whole(text), "\n", -1), lambda lines: _let(numbered(lines), paired))


def repeated_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pairs of lines to remove: document key, ``line`` and ``until``."""
    keyed = docs.select(F.col(doc_id).isNull().alias("none"), *document_key(doc_id, text), F.col(text).alias("__text"))
    pairs = keyed.select("none", *KEY, F.explode(pairs_of("__text")).alias("p")).select("none", *KEY, "p.*")
    place = F.struct("none", *KEY, "line")
    known = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # a hash that two different lines share is left alone
    lines = keyed.select(F.explode(F.split(whole("__text"), "\n", -1)).alias("line")).select(F.xxhash64("line").alias("h"), "line").distinct()
    shared = lines.groupBy("h").count().where("count > 1")
    for h in ("h1", "h2"):
        known = known.join(shared.select(F.col("h").alias(h)), h, "left_anti")
    return pairs.join(known, ["h1", "h2"]).where(F.struct("none", *KEY, "line") != F.col("first")).select(*KEY, "line", "until")


@own_names()
def without_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages of two lines or more cut from ``text``; ``n_removed_lines`` is added."""
    gone = repeated_pairs(docs, text, doc_id).groupBy(KEY).agg(F.collect_set(F.struct("line", "until")).alias("__gone"))  # at most the lines of a text
    columns = [c for c in docs.columns if c != "n_removed_lines"]
    joined = docs.select(*columns, *document_key(doc_id, text)).join(gone, KEY, "left")
    parts = lambda lines: _let(
        F.array_except(F.sequence(F.lit(1), F.size(lines)), F.flatten(F.transform("__gone", lambda g: F.sequence(g["line"], g["until"])))),
        lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i - 1)), "\n").alias("kept"), (F.size(lines) - F.size(kept)).cast("long").alias("lines")),
    )
    cut = joined.where("__gone is not null").withColumn("__cut", _let(F.split(whole(text), "\n", -1), parts))
    plain = joined.where("__gone is null").select(*columns, F.lit(0).cast("long").alias("n_removed_lines"))
    return plain.unionByName(cut.select(*(F.col("__cut.kept").alias(text) if c == text else F.col(c) for c in columns), F.col("__cut.lines").alias("n_removed_lines")))
