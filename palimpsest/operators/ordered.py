"""Whole-table and per-key order without a task that sees more than a range of the rows.

Rows are cut by Spark's range partitioning over the full order (all its columns, and the place of arrival behind them), so
rows that are equal in the first columns are cut apart as well. The number of the range is written beside the rows;
everything after that is a group of one range, or a row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.arrays import fold_to_array
from palimpsest.operators.skew import join_dimension, shared_folder

# Rows of a range, about; sampled cuts may make one up to twice as long.
RANGE_ROWS = 100_000
# Partitions that the ranges are cut in, at most, and room for the ranges of a partition in their number.
RANGE_PARTS, PART_RANGES = 2_000, 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to a folder that all executors reach and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(
    df: DataFrame, order: list[Column], name: str = "range", rows: int = RANGE_ROWS
) -> DataFrame:
    """The rows, written in ranges of `order`, with the number of their range in column `name`.

    Numbers grow with the order, and some may be left out. Range cuts rest on a sample, so they are
    drawn from written rows: a repeated task finds them again. A partition is sorted and holds many ranges where these are short,
    so their number does not make tasks or files.
    """
    kept = stored(df.withColumn(name, F.lit(0)))
    total = kept.count()
    if total <= rows:
        return kept
    cuts = min(max(-(-2 * total // max(rows, RANGE_ROWS)), 2), RANGE_PARTS)
    spread = kept.repartitionByRange(cuts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    placed = spread.withColumn("_at", F.monotonically_increasing_id())
    inside = F.expr(f"(_at & {(1 << 33) - 1}L) div {rows}")
    number = (F.shiftright("_at", 33) * PART_RANGES + inside).cast("int")
    return stored(placed.withColumn(name, number).drop("_at"))


def running_counts(counted: DataFrame, place: str, count: str, name: str) -> DataFrame:
    """Of one row per part of a table: `place` and, as `name`, the rows in all parts before it.

    The parts (not the rows) are summed up in one row.
    """
    item = f"struct<{place}:bigint,{name}:bigint,upto:bigint>"
    before = "coalesce(try_element_at(sums, -1).upto, 0L)"
    step = f"array_append(sums, named_struct('{place}', p.place, '{name}', {before}, 'upto', {before} + p.n))"
    parts = counted.select(F.col(place).cast("bigint").alias("place"), F.col(count).alias("n"))
    listed = parts.agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("parts"))
    sums = listed.select(F.explode(F.expr(fold_to_array("parts", item, "sums", "p", step))).alias("s"))
    return sums.select(F.col(f"s.{place}"), F.col(f"s.{name}"))


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], name: str, rows: int = RANGE_ROWS
) -> DataFrame:
    """Row number from 1 per key in `order`. A key may hold any number of rows."""
    ranged = in_ranges(df, [*(F.col(k) for k in keys), *order], "_range", rows)
    own = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*own).agg(F.count("*").alias("_n"))
    offsets = counts.select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    out = join_dimension(inside, offsets, own, "inner")
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_range", "_before")
