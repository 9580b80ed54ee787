"""Exact substring deduplication with suffix arrays built by induced sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed. Equal strings have
to meet in one shard, so each string is filed under an anchor that depends on its content alone: the run of
``GRAM`` bytes with the smallest hash in it. Strings of a document with the same anchor overlap and lie in
one short stretch, its context. Contexts are compared in two steps:

1. Equal contexts (by anchor and a 128-bit hash) are counted. Context repeated as a whole: all its strings are
   repeats. An anchor with a single context, seen once: none is. Groups of copies end here, as counts.
2. Anchors with several different contexts: one text of each goes to the anchor's shard. The shard's suffix array is
   built by induced sorting, and common prefixes in text order tell which strings occur twice.

An anchor with more than ``hot`` different contexts would overfill a shard; its strings are counted one by one, by
a 128-bit hash of each string, which partial counts spread over all tasks. Nothing is capped.

Defined results: null texts have no bytes; equal rows are two documents, so their strings are repeats; texts shorter than ``length``
lose nothing; an empty table gives an empty result; other columns are not carried. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.induced import common_prefixes, suffix_array
from palimpsest.llm.shared import KEY, document_key, written

LENGTH = 400
GRAM = 160
#: Different contexts under one anchor, from which its strings are counted instead.
HOT = 4000
#: Bytes of context in a shard, about.
SHARD_BYTES = 1 << 20
#: Windows looked at together in a long text.
STRETCH = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the base of the rolling hash and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factors = np.full(size, _BASE, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = _INVERSE
            self.down = np.multiply.accumulate(factors)
        return self.up[:n], self.down[:n]


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def contexts(text: bytes, length: int, gram: int, powers: _Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First string, number of strings and anchor of each context, for stretches of the text."""
    raw = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    for begin in range(0, len(raw) - length + 1, STRETCH):
        part = raw[begin : begin + STRETCH + length - 1]
        up, down = powers.reach(len(part) + 1)
        sums = np.append(np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64))
        grams = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        places = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 22) - 1)
        anchor = (_least_in_windows((grams & ~low) | places, width) & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        yield first + begin, np.diff(np.append(first, len(anchor))), grams[anchor[first]].view(np.int64)


def _two_longs(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)


def _filed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, value in enumerate(batch.column(2)):
                text = value.as_py()
                if text is None or len(text) < length:
                    continue
                for first, count, anchor in contexts(text, length, gram, powers):
                    ends = first + count + length - 1
                    digests = _two_longs([text[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
                    for column, values in zip(out, (np.full(len(first), ids[row]), np.full(len(first), hashes[row]), first, count, anchor, digests[:, 0], digests[:, 1]), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=[*KEY, "first", "count", "anchor", "c1", "c2"])

    return run


def _repeats(length: int):
    """Strings of a shard's contexts that occur twice: per context seen once, runs of first bytes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows["piece"].tolist()
        sizes = np.array([len(t) for t in texts], np.int64)
        # bytes become 2..257, every context ends with a 1, the whole with a 0
        s = np.full(int(sizes.sum()) + len(texts) + 1, 1, np.int64)
        starts = np.cumsum(np.append(0, sizes[:-1] + 1))
        for at, text in zip(starts.tolist(), texts, strict=True):
            s[at : at + len(text)] = np.frombuffer(text, np.uint8)
            s[at : at + len(text)] += 2
        s[-1] = 0
        sa = suffix_array(s)
        shared = common_prefixes(s, sa, 1)[sa] >= length
        twice = np.zeros(len(s), bool)
        twice[sa[shared]] = True
        twice[sa[np.flatnonzero(shared) - 1]] = True
        edge = np.diff(np.concatenate([[0], twice.view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a run ends before a context does
        context = np.searchsorted(starts, a, side="right") - 1
        own = rows.iloc[context]
        first = own["first"].to_numpy() + a - starts[context]
        found = pd.DataFrame({"__id": own["__id"].to_numpy(), "__hash": own["__hash"].to_numpy(), "first": first, "count": b - a})
        return found[(own["n"] == 1).to_numpy()]

    return run


def _strings(length: int):
    """A row for each string of a hot anchor's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for k, piece in enumerate(columns["piece"]):
                count = len(piece) - length + 1
                digests = _two_longs([piece[a : a + length] for a in range(count)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(count, columns[c][k])) for c in KEY), pa.array(columns["first"][k] + np.arange(count)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(np.full(count, columns["n"][k]))],
                    names=[*KEY, "first", "w1", "w2", "n"],
                )

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Runs of repeated strings: document key, ``first`` (first byte of the first string) and ``count`` (of strings)."""
    keyed = docs.select(*document_key(doc_id, text), F.col(text).cast("binary").alias("__text"))
    context = ["anchor", "c1", "c2"]
    filed = written(keyed.mapInArrow(_filed(length, gram), "__id long, __hash long, first long, count long, anchor long, c1 long, c2 long"), "contexts")
    seen = filed.groupBy(context).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "count")).alias("at"))
    seen = written(seen, "seen")
    kinds = seen.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("at.count") + length - 1).alias("bytes")).where("kinds > 1")
    whole = filed.join(seen.where("n > 1").select(*context), context, "left_semi").select(*KEY, "first", "count")
    mixed = seen.join(kinds, "anchor").select("anchor", "kinds", "bytes", "n", "at.*")
    wanted = mixed.groupBy(KEY).agg(F.collect_list(F.struct("anchor", "kinds", "bytes", "n", "first", "count")).alias("pieces"))  # at most the contexts of a text
    piece = F.substring(F.col("__text"), F.col("p.first").cast("int") + 1, F.col("p.count").cast("int") + length - 1)
    pieces = keyed.join(wanted, KEY).select(*KEY, "__text", F.explode("pieces").alias("p"))
    pieces = pieces.select(*KEY, "p.anchor", "p.kinds", "p.bytes", "p.n", "p.first", piece.alias("piece"))
    pieces = written(pieces, "pieces")
    total = pieces.where(F.col("kinds") <= hot).agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # an anchor that fills a shard has one to itself
    shard = F.when(F.col("bytes") * 2 > shard_bytes, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sharded = pieces.where(F.col("kinds") <= hot).select("__id", "__hash", "n", "first", "piece", shard.alias("shard"))
    schema = "__id long, __hash long, first long, count long"
    by_array = sharded.groupBy("shard").applyInPandas(_repeats(length), schema)
    single = pieces.where(F.col("kinds") > hot).select(*KEY, "first", "n", "piece").mapInArrow(_strings(length), "__id long, __hash long, first long, w1 long, w2 long, n long")
    counted = single.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    by_count = single.where("n = 1").join(counted.select("w1", "w2"), ["w1", "w2"], "left_semi").select(*KEY, "first", F.lit(1).cast("long").alias("count"))
    return whole.unionByName(by_array).unionByName(by_count)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py() or b""
                gone = np.zeros(len(text) + 1, np.int32)
                if runs:
                    np.add.at(gone, [r["first"] for r in runs], 1)
                    np.add.at(gone, [r["first"] + r["count"] + length - 1 for r in runs], -1)
                covered = (np.cumsum(gone) > 0)[:-1]
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                spans = int((np.diff(np.append(False, covered).view(np.int8)) == 1).sum()) if len(covered) else 0
                rows.append((len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes) and kept_sha256 for every row of ``docs``."""
    runs = repeated_strings(docs, length, text=text, doc_id=doc_id, **limits)
    gathered = runs.groupBy(KEY).agg(F.collect_list(F.struct("first", "count")).alias("runs"))  # at most a text's strings
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *document_key(doc_id, text), F.col(text).cast("binary").alias("__text"))
    joined = keyed.join(gathered, KEY, "left").select("doc_id", "__text", "runs")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
