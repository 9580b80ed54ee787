"""A training corpus from raw documents in five stages, each a Spark job over all that the one before kept.

Every stage's result is written as Parquet and read again before the next, so a lost executor repeats no earlier stage.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, mixing, packing, simhash, toxicity
from palimpsest.llm.queries import MIX_SEED, domain, mix_weights
from palimpsest.llm.shared import own_names, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@own_names(1)
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier doesn't call toxic. It learns from the marked rows that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score="__score", predicted="__predicted").where("__predicted = 0").select(*docs.columns)


@own_names(1)
def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates, the one with the smallest id."""
    return simhash.deduplicated(docs)


@own_names(1)
def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@own_names(1)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, as many tokens as there are; a document taken in several epochs stands in as many rows."""
    sized = docs.select("*", domain().alias("__of"), mixing.token_count().alias("__size"))
    taken = mixing.mix(
        sized, mix_weights(spark), budget_share=1.0, max_epochs=3, seed=MIX_SEED, tokens="__size", columns=("__of", "lang", "source"), copies="__copies"
    )
    return mixing.repeated(taken, "__copies").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2048 token ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("benchmark_decontamination", benchmarks_out),
    ("source_mixing", mixed),
    ("token_packing", packed),
]

#: A trained classifier, XXH64 fingerprints and tokenizers are beyond SQL; tests hold the stages against plain models.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
