"""Periodic runs of words, found with minimizers at several scales.

A run is a stretch of words that repeats itself with a smallest period ``q`` at least ``times`` times, is at least
``words`` long and can't be extended by a neighbouring word. Texts are numbered word by word and laid end to end with a
separator of its own behind each, so one pass serves many texts and no run crosses two of them.

Scale ``w`` finds the periods from ``w`` to ``2w - 1``. Grams of ``2w`` words are hashed by doubling (two halves
mixed), and each window of ``w`` grams selects its leftmost minimum. Inside a run the choice repeats at period distance, and
equal grams lie a multiple of the period apart, since a gram is longer than it. So a selected place and the next one
with the same gram are one period apart at least once in each run of four periods: these pairs are the seeds. A seed is
compared and extended word by word in both directions; later seeds inside an extension are skipped, so the work of a scale is
linear in the words. Periods below ``SHORT`` are too short for windows; each is scanned directly at its own lag.

An extension that is a whole multiple of a shorter period covers the same words as that period's run, and the shortest
stays. False equality of hashes costs nothing, since words are compared; two different grams that hash alike
could hide a seed, with a chance of 2**-64 a pair.

Defined results: a null text has no words; texts of fewer than ``words`` words have no runs; equal rows have equal runs;
kept columns may have any name (one named like a result column gives way to it); an empty table gives an empty result. No shuffle; memory
grows with the longest text and with ``POOL``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.suffix import _least_in_windows

#: Shortest run in words, and in periods.
WORDS, TIMES = 6, 4
#: Periods below this are scanned at their own lag.
SHORT = 8
#: Words laid end to end, about.
POOL = 1 << 19
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of True that are at least ``least`` long."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= least
    return first[long], (end - first)[long]


def _reach(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in direction ``step``, hold the word that stands ``lag`` later."""
    count, size = 0, 64
    while True:
        a = at + step * count
        if a < 0 or a + lag >= len(codes):
            return count
        if step > 0:
            size = min(size, len(codes) - lag - a)
            differs = codes[a : a + size] != codes[a + lag : a + lag + size]
        else:
            size = min(size, a + 1)
            differs = (codes[a - size + 1 : a + 1] != codes[a - size + 1 + lag : a + 1 + lag])[::-1]
        hit = int(differs.argmax())
        if differs[hit]:
            return count + hit
        count, size = count + size, 2 * size


def _seeds(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring selected places with equal grams, for distances from ``w`` to ``2w - 1``."""
    low = np.uint64((1 << int(len(grams)).bit_length()) - 1)
    least = _least_in_windows((_mixed(grams) & ~low) | np.arange(len(grams), dtype=np.uint64), w) & low
    place = least[np.append(True, least[1:] != least[:-1])].astype(np.int64)
    order = place[np.argsort(grams[place], kind="stable")]
    a, b = order[:-1], order[1:]
    good = (grams[a] == grams[b]) & (b - a >= w) & (b - a < 2 * w)
    return a[good], (b - a)[good]


def runs_of(codes: np.ndarray, sizes: np.ndarray, words: int = WORDS, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``codes``: numbers of the words of texts of ``sizes`` words, each text followed by a number found nowhere else.
    ``times`` is at least 4, which the seeds rest on.
    """
    found: list[np.ndarray] = []
    longest = int(sizes.max(initial=0))
    for lag in range(1, min(SHORT, longest // times + 1)):
        first, length = _stretches(codes[lag:] == codes[:-lag], max(words - lag, (times - 1) * lag))
        found.append(np.stack([first, length + lag, np.full(len(first), lag)], axis=1))
    w, kept, own, grams = SHORT, np.arange(len(codes)), sizes, None
    while times * w <= longest:
        long = own >= times * w  # texts too short for any period of this scale are left out
        if not long.all():
            stays = np.repeat(long, own + 1)
            kept, own = kept[stays], own[long]
            grams = None if grams is None else grams[stays[: len(grams)]]
        if grams is None:
            grams, span = _mixed(codes[kept].astype(np.uint64) + np.uint64(1)), 1
        while span < 2 * w and len(grams) > span:
            grams = _mixed(grams[:-span] * np.uint64(0x9E3779B97F4A7C15) + _mixed(grams[span:]))
            span *= 2
        if len(grams) < w:
            break
        here = codes[kept]
        place, lag = _seeds(grams, w)
        last, end = 0, -1
        rows = []
        for k in np.lexsort((place, lag)).tolist():
            p, q = int(place[k]), int(lag[k])
            if q == last and p < end:
                continue
            right = _reach(here, p, q, 1)
            if right:
                last, end, left = q, p + right, _reach(here, p, q, -1)
                length = left - 1 + right + q
                if length >= max(words, times * q):
                    rows.append((kept[p - left + 1], length, q))
        found.append(np.array(rows, np.int64).reshape(-1, 3))
        w *= 2
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        again = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
        runs = runs[np.append(True, ~again)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _found(texts: list[list[bytes]], words: int, times: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of some texts: the first run of each (and one more number), all runs within their texts, the texts without repeats."""
    ids: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.append(0, sizes + 1))
    codes = np.empty(int(starts[-1]), np.int64)
    for at, text in zip(starts.tolist(), texts, strict=False):
        codes[at : at + len(text)] = [ids.setdefault(word, len(ids)) for word in text]
    codes[starts[1:] - 1] = len(ids) + np.arange(len(texts))
    runs = runs_of(codes, sizes, words, times)
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(gone) == 0
    bounds = np.searchsorted(runs[:, 0], starts)
    whole = [b" ".join(t if a == b else [t[i] for i in np.flatnonzero(stays[at : at + len(t)]).tolist()]) for t, at, a, b in zip(texts, starts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=False)]
    runs[:, 0] -= np.repeat(starts[:-1], np.diff(bounds))
    return bounds, runs, whole


def _columns(texts: list[list[bytes]], words: int, times: int) -> list[pa.Array]:
    bounds, runs, whole = _found(texts, words, times)
    structs = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), structs)
    return [pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(whole, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, times: int = TIMES) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``runs`` (start, length, period in words, by start and period) and ``collapsed``.

    ``collapsed`` is the text without the words that any run holds after its first period, joined by single spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, texts = 0, 0, []
            for value in batch.column(1):
                texts.append((value.as_py() or b"").split())  # bytes split at ASCII white space only
                size += len(texts[-1])
                if size >= POOL or first + len(texts) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *_columns(texts, words, times)], names=["row", "n_words", "runs", "collapsed"])
                    first, size, texts = first + len(texts), 0, []

    kept = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    row = F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in kept)).alias("row")
    rows = docs.select(row, F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL(FOUND)]))
    return found.select(*(F.col("row")[c].alias(c) for c in kept), "n_words", "runs", "collapsed")
