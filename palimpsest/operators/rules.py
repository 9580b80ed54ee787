"""Masking rules: drop or raise findings by type, confidence or value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.arrays import among, text_literal
from palimpsest.operators.scan import finding
from palimpsest.operators.skew import join_dimension

MIN_CONFIDENCE = 0.9


@dataclass(frozen=True)
class MaskingRule:
    """`strategy` is skip, lower_threshold, whitelist or blacklist; others keep the finding."""

    entity_type: str
    strategy: str
    min_confidence: float = MIN_CONFIDENCE
    values: tuple[str, ...] = ()


def apply_rules(entities: str, rules: list[MaskingRule]) -> str:
    """Rules on the entities of one row. The last rule of a type counts."""
    last = {rule.entity_type: rule for rule in rules}
    drop, raised = [], []
    for rule in last.values():
        mine = f"e.label = {text_literal(rule.entity_type)}"
        if rule.strategy == "skip":
            drop.append(mine)
        elif rule.strategy == "lower_threshold":
            drop.append(f"{mine} and e.confidence < {float(rule.min_confidence)}D")
        elif rule.strategy == "whitelist":
            drop.append(f"{mine} and {among('e.text', rule.values)}")
        elif rule.strategy == "blacklist":
            raised.append(f"{mine} and {among('e.text', rule.values)}")
    out = entities
    if drop:
        out = f"filter({out}, e -> not ({' or '.join(f'({d})' for d in drop)}))"
    if raised:
        sure = " or ".join(f"({r})" for r in raised)
        confidence = f"if({sure}, 1.0D, e.confidence)"
        out = f"transform({out}, e -> {finding('e', confidence=confidence)})"
    return out


def apply_rule_table(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules as a table (ordinal, entity_type, strategy, min_confidence, values), any number.

    Listed values are matched by a join, so lists may be long.
    """
    last = rules.groupBy("entity_type").agg(
        F.max_by(F.struct("strategy", "min_confidence", "values"), "ordinal").alias("_rule")
    )
    kinds = last.select(
        F.col("entity_type").alias("label"),
        F.col("_rule.strategy").alias("_strategy"),
        F.coalesce("_rule.min_confidence", F.lit(MIN_CONFIDENCE)).alias("_min"),
    )
    values = (
        last.select(F.col("entity_type").alias("label"), F.explode("_rule.values").alias("text"))
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    joined = join_dimension(entities, kinds, ["label"])
    joined = join_dimension(joined, values, ["label", "text"])
    listed = F.coalesce("_listed", F.lit(False))
    dropped = (
        F.when(F.col("_strategy") == "skip", F.lit(True))
        .when(F.col("_strategy") == "lower_threshold", F.col("confidence") < F.col("_min"))
        .when(F.col("_strategy") == "whitelist", listed)
        .otherwise(F.lit(False))
    )
    confidence = F.when((F.col("_strategy") == "blacklist") & listed, F.lit(1.0)).otherwise(
        F.col("confidence")
    )
    return (
        joined.where(~F.coalesce(dropped, F.lit(False)))
        .withColumn("confidence", confidence)
        .select(*entities.columns)
    )
