"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries integer weights. The budget of tokens flows down from the
root: the children of a node share its budget by weight, each up to what it can give (its tokens times the
largest number of epochs). What a child cannot use goes to its siblings by weight; only what a whole node
cannot use reaches the siblings of that node. Each leaf then takes a prefix of its epochs, every epoch being
the leaf's documents in an order of its own drawn from the seed: whole epochs first, then the documents of
the next epoch that start before the rest of the quota is used up, so a leaf passes its quota by less than
its last document.

Defined results: null keys are the leaf ``''``; a missing or negative weight counts as ``default_weight``
or 0; documents without tokens are taken in whole epochs only, or when they stand before the cut; equal rows
are separate documents; an empty table gives an empty result; other columns stay as they are.

Scale: leaves and 4096 order buckets per leaf are all that is ever gathered. Only the bucket in which a
leaf's quota ends is put in order row by row, so no leaf, however hot, is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import WORD, own_names, whole, written

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that name its bucket.
BUCKET_DIGITS = 3


def token_count(text: str = "text") -> Column:
    """Words of the text, the default measure of tokens."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def leaf_budgets(
    sizes: DataFrame, weights: DataFrame, budget: Column, max_epochs: int, levels: Sequence[str] = LEVELS, default_weight: int = 1
) -> DataFrame:
    """``sizes``: a row per leaf with its levels and ``tokens``. ``weights``: level columns (null: any) and ``weight``.

    A row of ``weights`` that names levels up to k and has null below sets the weight of that node.
    Returns the leaves with ``quota``. Integer division may leave a token per sibling unused.
    """
    levels = list(levels)
    nodes = sizes.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    for depth in range(1, len(levels) + 1):
        own = F.lit(True)
        for k, level in enumerate(levels):
            own = own & (F.col(level).isNotNull() if k < depth else F.col(level).isNull())
        given = weights.where(own).groupBy(levels[:depth]).agg(F.max(F.greatest(F.col("weight").cast("long"), F.lit(0))).alias(f"w{depth}"))
        nodes = nodes.join(given, levels[:depth], "left").withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(default_weight).cast("long")))
    for depth in range(len(levels), 0, -1):
        # a node of weight 0 gives nothing, and so adds nothing to what its ancestors can give
        below = F.col("cap") if depth == len(levels) else F.col(f"cap{depth}")
        nodes = nodes.withColumn(f"usable{depth}", F.when(F.col(f"w{depth}") > 0, below).otherwise(0))
        parents = levels[: depth - 1]
        first = F.row_number().over(Window.partitionBy(*levels[:depth]).orderBy(*levels)) == 1
        nodes = nodes.withColumn("_first", F.when(first, F.col(f"usable{depth}")).otherwise(0))
        if depth > 1:
            nodes = nodes.withColumn(f"cap{depth - 1}", F.sum("_first").over(Window.partitionBy(*parents)))
    nodes = nodes.withColumn("quota0", budget)
    for depth in range(1, len(levels) + 1):
        # a row per leaf: written, so that the plan doesn't double at each level
        nodes = _fill(written(nodes, "leaves"), depth, levels)
    return nodes.select(*levels, "tokens", F.col(f"quota{len(levels)}").alias("quota"))


def _fill(nodes: DataFrame, depth: int, levels: list[str]) -> DataFrame:
    """Share each parent's quota among its children by weight, each up to its capacity.

    Children in the order of capacity by weight: one is full when its share of what is left over by those
    before it reaches its capacity. The first that isn't full ends the full ones; the rest share by weight.
    """
    parents, child = levels[: depth - 1], levels[:depth]
    cap, weight, quota = f"usable{depth}", f"w{depth}", f"quota{depth - 1}"
    children = nodes.groupBy(child).agg(F.max(cap).alias("cap"), F.max(weight).alias("weight"), F.max(quota).alias("parent"))
    children = children.where((F.col("weight") > 0) & (F.col("cap") > 0))
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), levels[depth - 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    children = children.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"), F.sum("weight").over(after).alias("weights")
    ).withColumn("full", F.expr("cap * weights <= (parent - caps) * weight"))
    # once one is not full, none after it is
    full = F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0))
    children = children.withColumn("full", full)
    open_caps = F.max(F.when(~F.col("full"), F.struct(-F.col("caps"), F.col("weights")))).over(Window.partitionBy(*parents))
    children = children.withColumn("open", open_caps).withColumn("open", F.struct((-F.col("open")["col1"]).alias("caps"), F.col("open")["weights"].alias("weights")))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((parent - open.caps) * weight) div open.weights"))
    shares = children.select(*child, share.alias(f"quota{depth}"))
    return nodes.join(shares, child, "left").withColumn(f"quota{depth}", F.coalesce(f"quota{depth}", F.lit(0).cast("long")))


def order_key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """Place of a document in an epoch: 32 hex digits drawn from seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


@own_names()
def mix(
    docs: DataFrame,
    weights: DataFrame,
    budget_share: float = 1.0,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    levels: Sequence[str] = LEVELS,
    doc_id: str = "doc_id",
    tokens: str = "n_tokens",
    columns: Sequence[str] | None = None,
    copies: str = "copies",
) -> DataFrame:
    """``docs`` (with the level columns and a token count) plus ``copies``: in how many epochs the document is taken.

    ``columns`` names the level columns of ``docs`` where they differ from those of ``weights``. The budget is ``budget`` tokens, or ``budget_share`` of all there are. Documents taken in no epoch are left out.
    """
    levels = list(levels)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{level}") for level, c in zip(levels, columns or levels, strict=True)]
    own = [f"__{level}" for level in levels]
    keyed = docs.select("*", *key, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("__tokens"))
    sizes = keyed.groupBy(own).agg(F.sum("__tokens").alias("tokens"))
    total = F.floor(F.sum("tokens").over(Window.partitionBy()) * F.lit(budget_share)) if budget is None else F.lit(budget)
    named = weights.select(*(F.col(level).cast("string").alias(f"__{level}") for level in levels), "weight")
    quotas = leaf_budgets(sizes.withColumn("__total", total.cast("long")), named, F.col("__total"), max_epochs, own)
    quotas = quotas.where("tokens > 0 and quota > 0").select(
        *own, F.expr("quota div tokens").alias("__epochs"), F.expr("quota % tokens").alias("__rest")
    )
    quotas = written(quotas, "quotas")
    placed = keyed.join(quotas, own).withColumn("__key", order_key(seed, F.col("__epochs"), doc_id))
    bucket = F.substring("__key", 1, BUCKET_DIGITS)
    light = keyed.select(*own, doc_id, "__tokens").join(quotas, own).where("__rest > 0")
    sums = light.groupBy(*own, "__rest", F.substring(order_key(seed, F.col("__epochs"), doc_id), 1, BUCKET_DIGITS).alias("__bucket")).agg(F.sum("__tokens").alias("sum"))
    running = Window.partitionBy(*own).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("__before", F.coalesce(F.sum("sum").over(running), F.lit(0))).where("__before < __rest and __before + sum >= __rest")
    # the cut exists for each leaf with a rest: its tokens are more than the rest. A row per leaf, written, so
    # that Spark knows its size and need not shuffle the documents by leaf
    cut = written(cut.select(*own, F.col("__bucket").alias("__cut"), "__before"), "cuts")
    placed = placed.join(cut, own, "left").withColumn("__bucket", bucket)
    inside = placed.where("__bucket = __cut")
    start = Window.partitionBy(*own, "__bucket").orderBy("__key", F.col(doc_id), "__tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__more", (F.col("__before") + F.coalesce(F.sum("__tokens").over(start), F.lit(0)) < F.col("__rest")).cast("int"))
    outside = placed.where("__cut is null or __bucket <> __cut").withColumn("__more", F.coalesce((F.col("__bucket") < F.col("__cut")).cast("int"), F.lit(0)))
    return (
        outside.unionByName(inside)
        .withColumn("__copies", F.col("__epochs") + F.col("__more"))
        .where("__copies > 0")
        .select(*(c for c in docs.columns if c != copies), F.col("__copies").alias(copies))
    )


@own_names()
def repeated(taken: DataFrame, copies: str = "copies") -> DataFrame:
    """A row for each copy."""
    columns = [c for c in taken.columns if c != copies]
    return taken.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("__copy")).drop("__copy")
