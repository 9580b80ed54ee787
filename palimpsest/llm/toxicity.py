"""Toxicity by weak supervision.

Many weak voters look at a text: words and word beginnings found to be typical of toxic rows, and fixed
patterns of form. The marks of the training rows are one more voter, not the truth. A generative label model
(expectation maximisation) estimates how often each voter speaks on toxic and on other texts, then the
correlations left between voters given the label; voters that repeat each other share one vote's weight. Its
posterior labels train a linear classifier on counts of the same signs, which scores every text.

Fitting takes at most ``SAMPLE`` marked rows, the first by a hash of their id; scoring reads every whole text
once, without a shuffle. The model is a few hundred words and weights.

Defined results: null and empty texts get the score of a text without any sign; rows without an id are not held out;
equal rows score alike; without marked rows of both kinds every score is the share of toxic marks (0 without any);
other columns stay; labels, language, source and id never reach the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from palimpsest.llm.shared import own_names, written

#: Marked rows that the model is fitted on, at most.
SAMPLE = 10_000
#: How a lexicon voter qualifies: rows with it, and log odds of its rate; and how many a model has at most, those on most toxic rows first.
#: The size of the model is a parameter of the fit, as the sample's is.
SUPPORT, LOG_ODDS, VOTERS = 6, 2.0, 400
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
#: How often a row is marked toxic if it isn't, and if it is.
MARKS = (0.001, 0.95)
LETTERS = re.compile(r"[^\W\d_]+")
#: Pattern voters: name and expression; each speaks where it matches.
PATTERNS = (
    ("shouting", r"\b[A-Z]{2,}!!"),
    ("marks", r"[!?]{3,}"),
    ("masked_word", r"\b\w[*@#$%]{2,}\w*"),
    ("address", r"(?i)\b(?:you|your|du|tu|vous|usted)\b"),
    ("repeated_word", r"(?i)\b(\w{3,}) \1 \1\b"),
)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    voters: list[str] = field(default_factory=list)  # words, and beginnings written with a final *
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: float = 0.0  # the score where nothing could be learned

    def scores(self, signs: np.ndarray) -> np.ndarray:
        if not self.voters:
            return np.full(len(signs), self.share)
        z = (signs - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Signs:
    """Counts of a text's signs: per voter, per pattern, and in all."""

    def __init__(self, voters: list[str]) -> None:
        self.words = {v: k for k, v in enumerate(voters) if v[-1] != "*"}
        self.beginnings = {v[:-1]: k for k, v in enumerate(voters) if v[-1] == "*"}
        self.lengths = sorted({len(b) for b in self.beginnings})
        self.patterns = [re.compile(p) for _, p in PATTERNS]
        self.count = len(voters)
        self.size = self.count + len(PATTERNS) + 3

    def of(self, text: str) -> np.ndarray:
        out = np.zeros(self.size)
        words = Counter(LETTERS.findall(text.lower()))
        seen = hits = 0
        for word, times in words.items():
            found = self.words.get(word)
            speaks = found is not None
            if speaks:
                out[found] += times
            for n in self.lengths:
                place = self.beginnings.get(word[:n])
                if place is not None:
                    out[place] += times
                    speaks = True
            if speaks:
                seen += 1
                hits += times
        out = np.log1p(out)
        for k, pattern in enumerate(self.patterns):
            out[self.count + k] = pattern.search(text) is not None
        out[-3:] = np.log1p(seen), np.log1p(hits), 100 * hits / max(20, words.total())
        return out


def _candidates(sample: DataFrame, most: int) -> list[str]:
    """Words and beginnings whose rate among toxic rows is far above that among others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    counts = sample.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    size = sample.agg(F.sum("toxic").alias("T"), F.sum(1 - F.col("toxic")).alias("C")).first()
    starts = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    shorter = counts.select(F.explode(F.array_compact(F.array(*starts))).alias("word"), "t", "c").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / F.lit(size["T"] + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(size["C"] + 1.0))
    good = counts.unionByName(shorter).withColumn("odds", odds).where((F.col("t") >= SUPPORT) & (F.col("odds") >= LOG_ODDS))
    # a beginning or word that speaks as often as a shorter beginning of it speaks on the same rows: the shorter one stands for both
    known = good.select(F.col("word").alias("shorter"), F.col("t").alias("t0"), F.col("c").alias("c0"))
    bare = F.regexp_replace("word", r"\*$", "")
    above = F.explode(F.array_compact(F.array(*(F.when(F.length(bare) > n, F.concat(F.substring(bare, 1, n), F.lit("*"))) for n in BEGINNINGS))))
    same = good.withColumn("shorter", above).join(known, "shorter").where("t = t0 and c = c0").select("word").distinct()
    rows = good.join(same, "word", "left_anti").orderBy(F.col("t").desc(), F.col("odds").desc(), "word").limit(most).collect()
    return [r["word"] for r in rows]


def _rates(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How often each voter speaks on rows of label 0 and of label 1, drawn a little to its overall rate."""
    speaking = votes.mean(axis=0)
    rates = [(p @ votes + 0.1 * speaking) / (p.sum() + 0.1) for p in (1 - post, post)]
    return np.clip(np.stack(rates), 1e-4, 1 - 1e-4).astype(votes.dtype)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior label of each row, rate of speaking by label (2 x voters) and weight of each voter.

    ``votes``: rows x voters of 0 and 1; the last is the marks, whose rates are given. ``start``: a first guess of the labels. Correlations of the voters given
    the label are measured under that guess, and each voter is weighted down by those it repeats; otherwise a family
    of voters that always speak together would become the label. Expectation maximisation follows.
    """
    post = (0.02 + 0.96 * start).astype(votes.dtype)
    rates = _rates(votes, post)
    rest = votes - (post[:, None] * rates[1] + (1 - post)[:, None] * rates[0])
    rest /= np.sqrt((rest**2).mean(axis=0)) + 1e-9
    weight = 1 / np.maximum(1, np.clip(rest.T @ rest / len(votes), 0, 1).sum(axis=0))
    weight[-1] = 1
    for _ in range(rounds):
        rates = _rates(votes, post)
        rates[:, -1] = MARKS
        share = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        says = votes @ (weight * (np.log(rates[1]) - np.log(rates[0])))
        silent = (1 - votes) @ (weight * (np.log1p(-rates[1]) - np.log1p(-rates[0])))
        new = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + says + silent, -40, 40)))
        moved, post = np.abs(new - post).max(), new.astype(votes.dtype)
        if moved < 1e-4:
            break
    return post, rates, weight


def _linear(signs: np.ndarray, target: np.ndarray, ridge: float = 3.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the first weight is the constant."""
    x = np.column_stack([np.ones(len(signs)), signs])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (target - p) - penalty * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = VOTERS) -> Model:
    """Learn from rows of ``labels`` that aren't held out."""
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")  # at most ``sample`` ids
    # documents that share an id could be more than the sample
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(sample).select("text", "toxic")
    rows = written(rows.repartition(max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "marked")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or toxic in (0, total):
        return Model(share=toxic / total if total else 0.0)
    voters = _candidates(rows, most)
    if not voters:
        return Model(share=toxic / total)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(voters)
        for batch in batches:
            found = [signs.of(t.as_py()).astype("<f4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["signs", "toxic"])

    got = rows.mapInArrow(read, "signs binary, toxic int").toArrow()  # at most ``sample`` rows of about a kilobyte
    marks = got["toxic"].to_numpy().astype(np.float32)
    signs = np.frombuffer(b"".join(got["signs"].to_pylist()), "<f4").reshape(len(marks), -1)
    votes = np.column_stack([signs[:, : len(voters) + len(PATTERNS)] > 0, marks]).astype(np.float32)
    post, _, _ = label_model(votes, marks)
    centre, scale = signs.mean(axis=0), signs.std(axis=0) + 1e-3
    return Model(voters, _linear((signs - centre) / scale, post), centre, scale, toxic / total)


@own_names()
def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), in place of columns of those names."""
    columns = [c for c in docs.columns if c not in (score, predicted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(model.voters)
        for batch in batches:
            values = np.array([signs.of(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]).reshape(-1, signs.size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(values))], names=[*batch.schema.names[:-1], score])

    plain = docs.select(*columns, F.col(text).alias("__text"))
    schema = StructType([*docs.select(*columns).schema.fields]).add(score, DoubleType())
    return plain.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
