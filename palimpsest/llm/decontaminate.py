"""Benchmark decontamination with windows that start at shared shingles.

An item of n words is looked for in windows of n words. A window counts if the weighted Jaccard similarity of
its shingles (``SHINGLE`` words, repeats weigh) with the item's is ``SIMILARITY`` or more.

1. Windows: a window that shares shingles with an item can be moved on, without losing any, until it starts
   with a shared shingle. So windows start where a text has a shingle of an item; other places can't be better.
2. Equal windows are one. Each is compared exactly, by counts of shingles, with the items that share its first one: a
   filter by fingerprints would lose pairs whose fingerprints happen to lie far apart.

Everything is built from DataFrame functions. The shingles of the benchmark are broadcast only when they are
counted to be few (``BROADCAST``), else joined with a shuffle. Texts are shingled whole; there is no cap.

Defined results: words are compared in lower case; items under ``SHINGLE`` words are one shingle of their own
length; null or empty items and texts match nothing; equal rows are each reported; items without an id are told apart by their words; other columns are not carried;
an empty table gives an empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import KEY, document_key, let, own_names, whole, written

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of the benchmark that may be broadcast.
BROADCAST = 1_000_000
ITEM = ["item_id", "item_text"]


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(whole(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(listed: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(listed) - size)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(listed), i + k) for k in range(size))))
    return F.when(F.size(listed) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda listed, h: F.size(F.filter(listed, lambda x: x == h))
    weighed = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighed)
    return shared / (F.size(a) + F.size(b) - shared)


def contaminated(
    docs: DataFrame, items: DataFrame, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id", broadcast: int = BROADCAST
) -> DataFrame:
    """For each document and item that it holds: doc_id, the document key, item_id, similarity (the best), n_windows, first_word."""
    listed = items.select("item_id", words("text").alias("item_words")).where(F.size("item_words") > 0).dropDuplicates()
    listed = listed.withColumn("item", F.md5(F.to_json(F.struct("item_id", "item_words"))))
    listed = listed.withColumn("item_text", F.when(F.col("item_id").isNull(), F.col("item")).otherwise(F.lit("")))  # tells items without an id apart
    listed = listed.withColumn("k", F.least(F.size("item_words"), F.lit(SHINGLE)))
    sizes = sorted(row["k"] for row in listed.select("k").distinct().collect())  # at most SHINGLE numbers
    if not sizes:
        sizes = [SHINGLE]
    own = reduce(lambda other, k: F.when(F.col("k") == k, shingles("item_words", k)).otherwise(other), sizes, F.array().cast("array<bigint>"))
    listed = written(listed.withColumn("item_shingles", own).drop("item_words"), "items")
    many, longest = listed.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)), F.coalesce(F.max(F.size("item_shingles")), F.lit(1))).first()
    small = (lambda frame: F.broadcast(frame)) if many <= broadcast else (lambda frame: frame)

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *document_key(doc_id, text), words(text).alias("words"))
    starts = listed.select("item", "k", F.size("item_shingles").alias("m"), F.explode("item_shingles").alias("h")).dropDuplicates()
    # an item's length is a number of words, so a shingle's sizes are few
    marks = written(starts.groupBy("k", "h").agg(F.sort_array(F.collect_set("m")).alias("sizes")), "marks")
    hits = reduce(
        DataFrame.unionByName,
        (
            keyed.select(*KEY, F.posexplode(shingles("words", k)).alias("at", "h")).join(small(marks.where(F.col("k") == k).drop("k")), "h").withColumn("k", F.lit(k))
            for k in sizes
        ),
    )
    places = hits.groupBy(KEY).agg(F.collect_set(F.struct("k", "at", "h", "sizes")).alias("places"))  # at most the shingles of a text
    places = written(places, "places")
    # few texts share a shingle with an item: counted to be few, their keys alone are sent out, and no other text moves
    near = keyed.join(F.broadcast(places.select(*KEY)), KEY, "left_semi") if places.count() <= broadcast else keyed
    held = near.join(places, KEY)
    # windows are cut while the text's hashes are at hand, so no row carries all of them
    cut_at = lambda k: let(
        shingles("words", k),
        lambda hashes: F.flatten(
            F.transform(
                F.filter("places", lambda p: p["k"] == k),
                lambda p: F.transform(p["sizes"], lambda m: F.struct(p["k"].alias("k"), p["at"].alias("at"), p["h"].alias("h"), m.alias("m"), F.slice(hashes, p["at"] + 1, m).alias("window"))),
            )
        ),
    )
    windows = held.select(*KEY, F.explode(F.concat(*(cut_at(k) for k in sizes))).alias("w"))
    cut = windows.select(*KEY, "w.*")
    content = [F.xxhash64("window", "m").alias("w1"), F.xxhash64(F.lit(1), F.reverse("window")).alias("w2")]
    cut = written(cut.select(*KEY, "k", "at", "h", "m", *content, "window"), "windows")

    ident = ["k", "h", "m", "w1", "w2"]
    kept = cut.groupBy(ident).agg(F.first("window").alias("window"))
    compared = kept.join(small(starts), ["k", "h", "m"]).join(small(listed.select("item", *ITEM, "item_shingles")), "item")
    found = compared.withColumn("similarity", similarity(F.col("window"), F.col("item_shingles")))
    found = written(found.where(F.col("similarity") >= least).select(*ident, *ITEM, "similarity"), "matches")

    best = cut.select(*KEY, "at", *ident).join(found, ident).groupBy(*KEY, *ITEM).agg(
        F.max("similarity").alias("similarity"), F.countDistinct("at").alias("n_windows"), F.min_by("at", F.struct(-F.col("similarity"), "at")).alias("first_word")
    )
    return keyed.select("doc_id", *KEY).join(best.drop("item_text"), KEY)


@own_names()
def clean(docs: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the documents that hold an item. All columns stay."""
    bad = contaminated(docs, items, **options).select(*KEY).distinct()
    return docs.select("*", *document_key()).join(bad, KEY, "left_anti").drop(*KEY)
