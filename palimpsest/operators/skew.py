"""Joins and groups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is not gathered into one row or one window.
HOT_ROWS = 200_000
# Keys or rows that may be listed on the driver or broadcast after being counted.
LISTED = 10_000
CUTS = 512


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. Counts are combined before the shuffle.

    Up to LISTED keys come back as a broadcast list, more as a plain DataFrame.
    """
    heavy = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    listed = heavy.limit(LISTED + 1).collect()
    if not listed:
        return None
    if len(listed) > LISTED:
        return heavy
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in heavy.schema.fields])
    return F.broadcast(df.sparkSession.createDataFrame(listed, schema))


def split_hot(
    df: DataFrame, keys: list[str], hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of hot keys."""
    if hot is None:
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def join_dimension(
    facts: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Join to a table with one row per key.

    Spark broadcasts it where its measured size allows, and else splits the fact rows of
    crowded partitions at run time. Nothing is counted before, no row is copied.
    """
    return facts.join(dimension, keys, how)


def join_documents(
    facts: DataFrame, docs: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join many rows per document to one row per document, as `join_dimension`."""
    return join_dimension(facts, docs, keys, how)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input arrives in few pieces. Large inputs pass unchanged."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key that each has its own value of, for work that takes far longer than moving them.

    How many pieces an input is read in says little of how its rows lie in them: a row group of a file is read by one task, whatever
    its rows. A join by the key that follows moves nothing again. The number of tasks is given, or else Spark would
    join them by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def where_computed(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows where a costly column holds. The outer form keeps the test behind what computes the column, which would else be
    computed again inside the test."""
    test = F.col(condition) if isinstance(condition, str) else condition
    return df.select("*", F.explode_outer(F.array(test)).alias("_holds")).where("_holds").drop("_holds")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder all executors reach: below the checkpoint folder the session names.

    Without one, as in tests, it is below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    base = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint that outlives executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ordered_chunks(
    df: DataFrame, keys: list[str], position: Column, tie: Column | None = None, cuts: int = CUTS
) -> DataFrame:
    """Cut the rows of each key into ranges of `position`, numbered in order as `chunk`.

    For hot keys only: the cut points are quantiles, found with partial aggregation. Rows with
    the same position share a chunk; one that holds a single position is cut further by `tie`.
    """
    first = _cut(df.withColumn("_at", position.cast("double")), keys, "chunk", cuts)
    if tie is None:
        return first.drop("_at")
    place = [*keys, "chunk"]
    level = first.groupBy(*place).agg((F.min("_at") == F.max("_at")).alias("_level"))
    tied = join_dimension(first, level, place, "inner")
    tied = tied.withColumn("_at", F.when(F.col("_level"), tie.cast("double")).otherwise(F.lit(0.0)))
    second = _cut(tied.drop("_level"), place, "_part", cuts).drop("_at")
    return second.withColumn("chunk", F.col("chunk") * cuts + F.col("_part")).drop("_part")


def _cut(placed: DataFrame, keys: list[str], name: str, cuts: int) -> DataFrame:
    """Number the ranges between quantiles of `_at` per key."""
    points = [i / cuts for i in range(1, cuts)]
    edges = placed.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_at", points, 10 * cuts)).alias("_edges")
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col("_at")))
    return join_dimension(placed, edges, keys, "inner").withColumn(name, below).drop("_edges")


def chunk_carry(
    df: DataFrame, keys: list[str], aggregates: list[Column], carried: list[Column]
) -> DataFrame:
    """Per chunk what the chunks before it add up to.

    `aggregates` sum up one chunk; `carried` are expressions over `before`, a window of the
    summed rows of the same key ahead of the chunk. A key has few chunks, whatever its rows.
    """
    sums = df.groupBy(*keys, "chunk").agg(*aggregates)
    return sums.select(*keys, "chunk", *carried)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    position: Column,
    name: str,
    limit: int = HOT_ROWS,
    tie: Column | None = None,
) -> DataFrame:
    """Row number per key in `order`. `position` must grow with the first order column, `tie` with the rest.

    Keys with more than `limit` rows are numbered chunk by chunk, and each chunk starts
    after the rows of the chunks before it.
    """
    plain, hot = split_hot(df, keys, hot_keys(df, keys, limit))
    out = plain.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return out
    chunked = ordered_chunks(hot, keys, position, tie).repartition(*keys, "chunk")
    inner = Window.partitionBy(*keys, "chunk").orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = chunk_carry(
        chunked,
        keys,
        [F.count("*").alias("_n")],
        [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")],
    )
    numbered = join_dimension(
        chunked.withColumn(name, F.row_number().over(inner)), carry, [*keys, "chunk"], "inner"
    )
    numbered = numbered.withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
    return out.unionByName(numbered.drop("chunk", "_before"))
