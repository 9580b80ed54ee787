"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Three steps, none of which shuffles a text:

1. Scan. Each text is read once. Base spans come from the patterns in ``KINDS``. Candidates are the values of assignments and all
   maximal runs of secret characters that are long enough (``SHORTEST``, ``LONG``); each is kept with ``AROUND`` bytes on either side
   and marked with whether a base span touches it: these marks are the labelled findings.
2. Fit. The network (convolution of width ``WIDTH`` over the characters, maximum and mean over the candidate, maximum over what stands before
   and behind, one hidden layer) is trained in numpy on at most ``SAMPLE`` findings of either mark, the first by a hash. Every
   second finding is shown without its surroundings, so a value is also known by itself. One value in ``FOLDS`` is kept out of training.
3. Thresholds. All candidates are scored. From counts of all held-out values by score (bins of the score, whatever the number of
   rows) the score is calibrated to a probability, and each shape of candidate (hexadecimal, capitals and digits, letters
   and digits, other) gets the largest threshold at which ``RECALL`` of its held-out findings are still reported; shapes with fewer than ``ENOUGH`` take the
   common one. A candidate at or above its threshold that no base span touches is added with kind ``network``.

Defined results: a null text is empty; spans are in code points, ends exclusive; equal rows have equal spans; without marked and
unmarked candidates to learn from, only base spans are reported; candidates of any length are read whole; kept columns
may have any name (one named like a result column gives way to it); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.shared import written

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
VALUE = 6
# the first match in a run of their letters is as long as the run, so the least lengths (20 and 24) may stand in the patterns
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
SECRET = np.zeros(256, bool)
SECRET[np.frombuffer(b"+/_.=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
#: A run of secret characters is a candidate from SHORTEST on if it has a digit, else from LONG on.
SHORTEST, LONG = 12, 16
AROUND = 24
#: Findings of each mark that the network is trained on, at most.
SAMPLE = 2500
FOLDS, RECALL, ENOUGH = 5, 0.98, 20
#: Bins of the score (a logit) for calibration: width and number on either side of 0.
BIN, BINS = 0.25, 80
SHAPES = 4
FILTERS, WIDTH, HIDDEN, EPOCHS, BATCH, RATE = 24, 5, 24, 10, 64, 0.004
OUTSIDE, FOREIGN = 128, 129
_CANDIDATE = "struct<start: long, end: long, found: boolean, shape: int, size: int, window: binary>"
_SCANNED = f"base array<struct<kind: int, start: long, end: long>>, candidates array<{_CANDIDATE}>"


def base_spans(text: bytes, runs: list[tuple[int, int]], keyed: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in bytes, and the values of assignments. ``runs`` are the text's long runs of secret characters."""
    spans, values = [], []
    if keyed:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    for a, b in runs:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text, a, b)]
    return sorted(spans), values


def _shape(value: bytes) -> int:
    if re.fullmatch(rb"[0-9A-Fa-f]+", value):
        return 0
    if re.fullmatch(rb"[0-9A-Z]+", value):
        return 1
    return 2 if value.isalnum() else 3


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of the runs of secret characters of at least SHORTEST bytes; ``offsets`` part the texts."""
    secret = SECRET[data]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    before, behind = np.append(False, secret[:-1]), np.append(secret[1:], False)
    before[bounds] = behind[bounds - 1] = False
    first, end = np.flatnonzero(secret & ~before), np.flatnonzero(secret & ~behind) + 1
    long = end - first >= SHORTEST
    return first[long], end[long]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        _, ends, values = column.buffers()
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        whole = memoryview(values)[offsets[0] : offsets[-1]] if values is not None else memoryview(b"")
        offsets = offsets - offsets[0]
        first, end = _runs(np.frombuffer(whole, np.uint8), offsets)
        in_text = np.searchsorted(offsets, first, side="right") - 1
        low, keyed = bytes(whole).lower(), set()
        for key in KEYS:
            at = low.find(key)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                keyed.add(text)
                at = low.find(key, int(offsets[text + 1]) - len(key) + 1)
        del low
        bases: list[list[dict]] = [[] for _ in range(len(column))]
        candidates: list[list[dict]] = [[] for _ in range(len(column))]
        bounds = np.searchsorted(in_text, np.arange(len(column) + 1))
        for text in sorted(keyed.union(in_text.tolist())):
            begin = int(offsets[text])
            raw = bytes(whole[begin : offsets[text + 1]])
            runs = [(int(a) - begin, int(b) - begin) for a, b in zip(first[bounds[text] : bounds[text + 1]], end[bounds[text] : bounds[text + 1]], strict=True)]
            bases[text], candidates[text] = _of_text(raw, runs, text in keyed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _ARROW[0]), pa.array(candidates, _ARROW[1])], names=["row", "base", "candidates"])


_ARROW = (
    pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("found", pa.bool_()), ("shape", pa.int32()), ("size", pa.int32()), ("window", pa.binary())])),
)


def _of_text(raw: bytes, runs: list[tuple[int, int]], keyed: bool) -> tuple[list[dict], list[dict]]:
    spans, values = base_spans(raw, runs, keyed)
    wanted = sorted({*values, *((a, b) for a, b in runs if b - a >= LONG or re.search(rb"[0-9]", raw[a:b]))})
    if not wanted and not spans:
        return [], []
    # code points before a byte: spans start and end beside ASCII bytes
    points = (lambda k: k) if raw.isascii() else np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)).tolist().__getitem__
    base = [{"kind": kind, "start": points(a), "end": points(b)} for a, kind, b in spans]
    starts, reach = [a for a, _, _ in spans], np.maximum.accumulate([b for _, _, b in spans]) if spans else np.zeros(0, np.int64)
    out = []
    for a, b in wanted:
        k = int(np.searchsorted(starts, b))  # base spans that start before the candidate ends
        out.append(
            {"start": points(a), "end": points(b), "found": bool(k and reach[k - 1] > a), "shape": _shape(raw[a:b]), "size": b - a,
             "window": b"\x00" * (AROUND - min(a, AROUND)) + raw[max(0, a - AROUND) : b + AROUND] + b"\x00" * (AROUND - min(len(raw) - b, AROUND))}
        )
    return base, out


_SYMBOLS = np.where(np.arange(256) < 128, np.arange(256), FOREIGN)
_SYMBOLS[0] = OUTSIDE


@dataclass
class Network:
    """Weights of the network, by name."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        wide = 4 * FILTERS + 1
        return Network({
            "conv": rng.normal(0, 0.3, (WIDTH, FOREIGN + 1, FILTERS)), "conv_bias": np.zeros(FILTERS), "hidden": rng.normal(0, wide**-0.5, (wide, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1),
        })

    def forward(self, windows: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        """Logits of windows of symbols, laid end to end, and what the gradient needs."""
        w, half = self.weights, WIDTH // 2
        sizes = np.array([len(x) for x in windows], np.int64)
        starts = np.cumsum(np.append(0, sizes[:-1]))
        gap = np.full(half, OUTSIDE)
        symbols = np.concatenate([gap, *(x for window in windows for x in (window, gap))])  # no window sees into the next
        n = int(sizes.sum())
        at = np.arange(n) + half * np.repeat(np.arange(len(windows)), sizes)
        raw = np.tile(w["conv_bias"], (n, 1))
        for k in range(WIDTH):
            raw += w["conv"][k][symbols[at + k]]
        active = np.maximum(raw, 0)
        # three parts of each window: before, the candidate, behind
        parts = np.stack([starts, starts + AROUND, starts + sizes - AROUND], axis=1).ravel()
        most = np.maximum.reduceat(active, parts, axis=0)
        inner = sizes - 2 * AROUND
        mean = np.add.reduceat(active, parts, axis=0)[1::3] / inner[:, None]
        pooled = np.concatenate([most.reshape(len(windows), -1), mean, np.log(inner)[:, None]], axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        return hidden @ w["out"] + w["out_bias"][0], {"symbols": symbols, "at": at, "active": active, "parts": parts, "most": most, "inner": inner, "pooled": pooled, "hidden": hidden, "n": n}

    def gradient(self, seen: dict, by_logit: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, seen["n"]
        to_hidden = np.outer(by_logit, w["out"]) * (seen["hidden"] > 0)
        pooled = to_hidden @ w["hidden"].T
        lengths = np.diff(np.append(seen["parts"], n))
        highest = seen["active"] == np.repeat(seen["most"], lengths, axis=0)
        ties = np.add.reduceat(highest, seen["parts"], axis=0, dtype=np.int64)
        active = highest * np.repeat(pooled[:, : 3 * FILTERS].reshape(-1, FILTERS) / ties, lengths, axis=0)
        mean = np.zeros_like(seen["most"])
        mean[1::3] = pooled[:, 3 * FILTERS : 4 * FILTERS] / seen["inner"][:, None]
        active = (active + np.repeat(mean, lengths, axis=0)) * (seen["active"] > 0)
        conv = np.zeros_like(w["conv"])
        for k in range(WIDTH):
            symbols = seen["symbols"][seen["at"] + k]
            order = np.argsort(symbols, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
            conv[k][symbols[order][first]] = np.add.reduceat(active[order], first, axis=0)
        return {
            "conv": conv, "conv_bias": active.sum(axis=0), "hidden": seen["pooled"].T @ to_hidden, "hidden_bias": to_hidden.sum(axis=0),
            "out": seen["hidden"].T @ by_logit, "out_bias": np.array([by_logit.sum()]),
        }

    def scores(self, windows: list[bytes]) -> np.ndarray:
        """Logits, worked out in pieces of some thousand characters (a longer candidate is a piece of its own)."""
        out, some, size = [], [], 0
        for k, window in enumerate(windows):
            some.append(_symbols(window))
            size += len(window)
            if size >= 20_000 or k + 1 == len(windows):
                out.append(self.forward(some)[0])
                some, size = [], 0
        return np.concatenate([np.zeros(0), *out])


def _symbols(window: bytes) -> np.ndarray:
    return _SYMBOLS[np.frombuffer(window, np.uint8)]


def trained(windows: list[bytes], found: list[bool], seed: int = 7) -> Network:
    """Cross entropy of the marks, minimised by Adam; both marks weigh the same, and every second window is shown without its surroundings."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    bare = lambda x: np.concatenate([np.full(AROUND, OUTSIDE), x[AROUND : len(x) - AROUND], np.full(AROUND, OUTSIDE)])
    seen = [_symbols(w) for w in windows]
    y = np.array(found, float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(seen))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            logits, kept = net.forward([bare(seen[i]) if rng.random() < 0.5 else seen[i] for i in some])
            by_logit = (1 / (1 + np.exp(-logits)) - y[some]) * weight[some] / len(some)
            step += 1
            for name, g in net.gradient(kept, by_logit).items():
                m, v = slow[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.weights[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Limits:
    """Calibration of the score (probability = logistic of ``slope`` * score + ``shift``) and a threshold for each shape."""

    slope: float
    shift: float
    least: list[float]

    def probability(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * score + F.lit(self.shift))))


def calibrated(counts: list[tuple[int, int, bool, int]], recall: float = RECALL) -> Limits | None:
    """From rows (shape, bin, found, number) of held-out candidates; None without found and other ones.

    Calibration is logistic regression on the middle of each bin, by Newton's steps, with a weak pull to the score as it is.
    """
    shape, at, found, number = (np.array(x, float) for x in zip(*counts, strict=True)) if counts else (np.zeros(0),) * 4
    if not (found > 0).any() or not (found == 0).any():
        return None
    middle = (at + 0.5) * BIN
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * middle + b)))
        error, bend = number * (p - found), number * p * (1 - p) + 1e-9
        slope = np.array([(error * middle).sum() + (a - 1), error.sum() + b])
        curve = np.array([[(bend * middle**2).sum() + 1, (bend * middle).sum()], [(bend * middle).sum(), bend.sum() + 1]])
        move = np.linalg.solve(curve, slope)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -5, 5))
    if a <= 0:
        return None  # the score says nothing

    def least(of: np.ndarray) -> float:
        order = np.argsort(-at[of], kind="stable")
        reached = np.cumsum(number[of][order]) >= recall * number[of].sum()
        return float(1 / (1 + np.exp(-(a * at[of][order][reached][0] * BIN + b))))  # the lower end of the bin

    positive = found > 0
    common = least(positive)
    own = [positive & (shape == k) for k in range(SHAPES)]
    return Limits(a, b, [least(o) if number[o].sum() >= ENOUGH else common for o in own])


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.expr(f"substring(c.window, {AROUND + 1}, c.size)")), F.lit(FOLDS))


def _with_scores(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            scores = pa.array(net.scores(flat.field("window").to_pylist()), pa.float64())
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32))
            scored = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat, scores], names=["c", "score"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], scored], names=["row", "base", "scored"])

    return run


def secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Columns ``keep`` and ``spans``: structs (``start``, ``kind``, ``end``, ``probability``) by start, then kind as listed in ``KINDS``.

    ``kind`` is its place in ``KINDS``; base spans have no probability.
    """
    kept = [c for c in keep if c != "spans"]
    row = F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in kept)).alias("row")
    rows = docs.select(row, F.col(text).cast("binary").alias("text"))
    found = written(rows.mapInArrow(_scanned, StructType([rows.schema["row"], *StructType.fromDDL(_SCANNED)])), "candidates")
    each = found.select(F.explode("candidates").alias("c")).where(_fold() != 0).select("c.window", "c.found")
    by_hash = (F.xxhash64("window"), F.col("window"))
    chosen = [r for mark in (True, False) for r in each.where(F.col("found") == mark).distinct().orderBy(*by_hash).limit(sample).collect()]
    limits = None
    if len({r.found for r in chosen}) == 2:
        net = trained([bytes(r.window) for r in chosen], [r.found for r in chosen])
        schema = StructType([found.schema["row"], found.schema["base"], *StructType.fromDDL(f"scored array<struct<c: {_CANDIDATE}, score: double>>")])
        scored = written(found.select("row", "base", "candidates").mapInArrow(_with_scores(net), schema), "scored")
        held = scored.select(F.explode("scored").alias("s")).select("s.c", "s.score").where(_fold() == 0)
        at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS - 1), F.floor(F.col("score") / BIN))).cast("int")
        counts = held.groupBy(F.col("c.shape").alias("shape"), at.alias("at"), F.col("c.found").alias("found")).count()  # at most 2 * BINS rows a shape and mark
        limits = calibrated([tuple(r) for r in counts.collect()], recall)
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("double").alias("probability")))
    if limits is None:
        return found.select(*(F.col("row")[c].alias(c) for c in kept), F.array_sort(base).alias("spans"))
    least = F.array(*(F.lit(x) for x in limits.least))
    chance = lambda s: limits.probability(s["score"])
    new = F.filter("scored", lambda s: ~s["c"]["found"] & (chance(s) >= F.element_at(least, s["c"]["shape"] + 1)))
    new = F.transform(new, lambda s: F.struct(s["c"]["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), s["c"]["end"].alias("end"), chance(s).alias("probability")))
    return scored.select(*(F.col("row")[c].alias(c) for c in kept), F.array_sort(F.concat(base, new)).alias("spans"))
