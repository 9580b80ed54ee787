"""SimHash near-duplicates found with vantage-point trees.

Texts are reduced to 64-bit fingerprints, and fingerprints to the distinct ones, so a group of equal texts
is one point however large it is. A vantage-point tree, built from a bounded sample, cuts the space of
fingerprints into shards: at each node, points within the radius of the vantage point go one way, the others
the other way. A point has one home shard and also visits every later shard that the triangle inequality can't
rule out for the link distance, so all pairs meet, in the later home of the two. Inside a shard a deeper tree of the same kind prunes the
search, and leaves are compared in full. A shard passes on only a spanning set of its links, at most one per
point, and the components are found from those.

The sample only shapes the shards: for any tree the links are exact. Shards that come out too large are split
by hash, their visitors going to every part. Near copies cannot pile up without bound in one place, because
points are distinct: at most 679,121 fingerprints lie within 4 bits of one.

Defined results: null texts are empty and have the fingerprint 0, linked like any other; texts of fewer words than
a shingle are one shingle; equal rows are in one component; a component without any id has a null
``component_id``; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import roots
from palimpsest.llm.shared import KEY, document_key, own_names, written

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints that shape the shards, at most.
SAMPLE = 20_000
SHARD_POINTS = 20_000
LEAF_POINTS = 128
#: Vantage points tried for a node of the shards, and points they are tried on.
TRIED, TRIED_ON = 64, 2000
#: Compared at once inside a task.
PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: bytes | None, words_each: int = SHINGLE_WORDS) -> int:
    """Bit k is set if it is set in more than half of the shingles' XXH64."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    n = len(found)
    hashes = np.array(found, np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, the document key and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["doc_id", *KEY, "fp"])

    parts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *document_key(doc_id, text), F.col(text).cast("binary").alias("__text"))
    return parts.mapInArrow(run, "doc_id long, __id long, __hash long, fp long")


class Shards:
    """The upper part of a vantage-point tree; its leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int) -> None:
        self.radius = radius
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # vantage point, radius, inner and outer child (-1 - shard)
        self.count = 0
        self.root = self._built(sample, depth, np.random.default_rng(7))

    def _built(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if depth == 0 or len(points) < 4:
            self.count += 1
            return -self.count
        vantage, middle = self._split(points, rng)
        near = np.bitwise_count(points ^ vantage)
        inner, outer = points[near <= middle], points[near > middle]
        place = len(self.nodes)
        self.nodes.append((vantage, middle, 0, 0))
        self.nodes[place] = (vantage, middle, self._built(inner, depth - 1, rng), self._built(outer, depth - 1, rng))
        return place

    def _split(self, points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
        """Of some vantage points and radii that cut off 30 to 70 percent, the pair with the fewest points near the border.

        Points within the link distance of the border go both ways, so fewer of them mean fewer visits.
        """
        some = rng.permutation(points)[:TRIED_ON]
        best = None
        for vantage in rng.permutation(points)[:TRIED]:
            counts = np.bincount(np.bitwise_count(some ^ vantage), minlength=65)
            upto = np.cumsum(counts)
            border = upto[np.minimum(np.arange(65) + self.radius, 64)] - np.append(np.zeros(self.radius, np.int64), upto)[:65]
            fair = (upto >= 0.3 * len(some)) & (upto <= 0.7 * len(some))
            for middle in np.flatnonzero(fair) if fair.any() else [int(np.median(np.repeat(np.arange(65), counts)))]:
                if best is None or border[middle] < best[0]:
                    best = (border[middle], vantage, int(middle))
        return best[1], best[2]

    def route(self, points: np.ndarray, slack: int) -> Iterator[tuple[int, np.ndarray]]:
        """Shards and the places of the points that reach them. Slack 0 gives each point its home only."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, places = todo.pop()
            if node < 0:
                yield -node - 1, places
                continue
            vantage, middle, inner, outer = self.nodes[node]
            near = np.bitwise_count(points[places] ^ vantage).astype(np.int64)
            todo.append((inner, places[near - slack <= middle]))
            todo.append((outer, places[near + slack > middle]))


class Links:
    """Links found so far, kept down to a spanning set."""

    def __init__(self) -> None:
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append(np.stack([a, b], axis=1))
            self.size += len(a)
            if self.size > PAIRS_AT_ONCE:
                self.shrink()

    def shrink(self) -> np.ndarray:
        if not self.found:
            return np.zeros((0, 2), np.uint64)
        nodes, ends = np.unique(np.concatenate(self.found), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            new = new[new]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        other = label != np.arange(len(nodes))
        self.found = [np.stack([nodes[other], nodes[label[other]]], axis=1)]
        self.size = len(self.found[0])
        return self.found[0]


def search(points: np.ndarray, queries: np.ndarray, radius: int, links: Links, rng: np.random.Generator, same: bool = False) -> None:
    """Links of at most ``radius`` between ``queries`` and ``points``; if they are the ``same``, each pair once, from its smaller side."""
    todo = [(points, queries)]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) > LEAF_POINTS:
            vantage = points[rng.integers(len(points))]
            near, reach = np.bitwise_count(points ^ vantage).astype(np.int16), np.bitwise_count(queries ^ vantage).astype(np.int16)
            middle = int(np.median(near))
            inner = near <= middle
            if inner.any() and not inner.all():
                todo.append((points[inner], queries[reach <= middle + radius]))
                todo.append((points[~inner], queries[reach > middle - radius]))
                continue
        step = max(1, PAIRS_AT_ONCE // len(points))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            q, p = np.nonzero(np.bitwise_count(some[:, None] ^ points[None, :]) <= radius)
            a, b = some[q], points[p]
            once = a < b if same else slice(None)
            links.add(a[once], b[once])


def linked(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS, sample: int = SAMPLE) -> DataFrame:
    """A spanning set (``a``, ``b``) of all links between the distinct longs ``fp`` of ``points``."""
    count = points.count()
    shape = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, count) / shard_points))))
    shards = Shards(shape, min(depth, int(np.log2(max(1, len(shape))))), radius)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for shard, places in shards.route(fps, 0):
                yield pd.DataFrame({"shard": shard, "n": len(places)}, index=[0])

    sizes = points.select("fp").mapInPandas(homes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row per shard
    parts = {row["shard"]: max(1, -(-row["n"] // (2 * shard_points))) for row in sizes}

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            own = np.empty(len(fps), np.int64)
            for shard, places in shards.route(fps, 0):
                own[places] = shard
            for shard, places in shards.route(fps, radius):
                n = parts.get(shard, 1)
                places = places[own[places] <= shard]
                mine = (fps[places] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                for part in range(n):
                    home = (own[places] == shard) & (mine == part)
                    # points of the same home meet in the part of the later one
                    comes = home | (own[places] < shard) | (mine < part)
                    if comes.any():
                        yield pd.DataFrame({"shard": np.int32(shard), "part": np.int32(part), "fp": fps[places[comes]].view(np.int64), "home": home[comes]})

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        fps, home = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool)
        links = Links()
        search(fps[home], fps[home], radius, links, np.random.default_rng(7), same=True)
        search(fps[home], fps[~home], radius, links, np.random.default_rng(7))
        found = links.shrink().view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    reached = points.select("fp").mapInPandas(visits, "shard int, part int, fp long, home boolean")
    return reached.groupBy("shard", "part").applyInPandas(inside, "a long, b long")


def components(fps: DataFrame, radius: int = RADIUS, **shape: int) -> DataFrame:
    """For each distinct ``fp``: ``first``, the first document of its component (``missing``, ``doc_id``, ``__hash``)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__hash")).alias("first")
    points = written(fps.groupBy("fp").agg(first), "points")
    root = roots(written(linked(points, radius, **shape), "links"))
    rooted = points.join(root, points["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, **shape: int) -> DataFrame:
    """A row per document: ``doc_id``, its key, ``fp`` and ``first``, the first document of its component."""
    fps = written(fingerprints(docs), "fingerprints")
    return fps.join(components(fps, radius, **shape), "fp")


@own_names()
def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. All columns stay."""
    found = near_duplicates(docs, radius)
    stays = found.where(F.col("first")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("first")["__hash"] == F.col("__hash"))).select(*KEY).distinct()
    keyed = docs.select("*", *document_key())
    return keyed.join(stays, KEY, "left_semi").dropDuplicates(KEY).drop(*KEY)
