"""Logo boxes and redaction regions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import one_of
from palimpsest.operators.components import components
from palimpsest.operators.ordered import stored
from palimpsest.operators.skew import (
    HOT_ROWS,
    checkpointed,
    hot_keys,
    join_dimension,
    number_rows,
    split_hot,
)
from palimpsest.operators.stats import percent

BOX = ["x1", "y1", "x2", "y2"]
# Each box is compared with all kept ones, so suppression inside one row is for fewer boxes.
SUPPRESSION_ROWS = 2_000
# Boxes that one task goes through in order, looking up the kept ones near each.
SWEPT_ROWS = 200_000


def logo_classes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Logo classes from a JSON file of (class_id, name, category, sensitive), or the usual ten."""
    schema = "class_id int, name string, category string, sensitive boolean"
    if path is not None:
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame(list(C.LOGO_CLASSES), schema)


def class_names(classes: DataFrame) -> DataFrame:
    """Names of the known logo classes."""
    return classes.orderBy("class_id").select("name")


def sure_boxes(boxes: DataFrame, threshold: Column | float = C.LOGO_THRESHOLD) -> DataFrame:
    return boxes.where(F.col("confidence") >= threshold)


def classified(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes with class name, sensitivity and area. Unknown classes are not sensitive."""
    known = classes.select("class_id", F.col("name").alias("class_name"), "sensitive")
    width = F.col("x2").cast("bigint") - F.col("x1")
    return (
        join_dimension(boxes, known, ["class_id"])
        .withColumn(
            "class_name",
            F.coalesce("class_name", F.concat(F.lit("unknown_"), F.col("class_id").cast("string"))),
        )
        .withColumn("sensitive", F.coalesce("sensitive", F.lit(False)))
        .withColumn("area", width * (F.col("y2") - F.col("y1")))
    )


def ranked(boxes: DataFrame, key: str = "doc_id", limit: int = HOT_ROWS) -> DataFrame:
    """Boxes numbered per document as `rank`, the surest first."""
    order = [F.col("confidence").desc(), F.col("seq")]
    return number_rows(boxes, [key], order, -F.col("confidence"), "rank", limit, F.col("seq"))


def top_boxes(boxes: DataFrame, k: int = C.LOGO_MAX_DETECTIONS, key: str = "doc_id") -> DataFrame:
    """The k surest boxes of each document. Each task keeps k per document before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.col("confidence").desc(), F.col("seq"))
    return boxes.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def overlaps(a: str, b: str, iou: float) -> str:
    """Whether two boxes share more than `iou` of their union. A box turned inside out has no area."""
    wide = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"
    high = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    inter = f"cast({wide} as double) * {high}"

    def area(box: str) -> str:
        return f"cast(greatest({box}.x2 - {box}.x1, 0) as double) * greatest({box}.y2 - {box}.y1, 0)"

    return f"({inter} > {float(iou)}D * ({area(a)} + {area(b)} - {inter}))"


def suppress(
    boxes: DataFrame,
    iou: float = C.LOGO_IOU,
    key: str = "doc_id",
    by_class: bool = True,
    limit: int = SUPPRESSION_ROWS,
    swept: int = SWEPT_ROWS,
) -> DataFrame:
    """Drop boxes that overlap a kept, surer box of the same document and class.

    Groups of up to `limit` boxes are compared inside one row, groups of up to `swept` are gone through by one task with
    a grid. Larger groups fall apart into components of the grid first, each of them a group; what is
    larger still goes in rounds.
    """
    keys = [key, "class_id"] if by_class else [key]
    plain, hot = split_hot(boxes, keys, hot_keys(boxes, keys, limit))
    item = F.struct(
        (-F.col("confidence")).alias("_rank"),
        F.col("seq"),
        *[F.col(c) for c in boxes.columns if c not in (*keys, "seq")],
    )
    kept = (
        f"aggregate(_items, slice(_items, 1, 0), (kept, b) -> "
        f"if(exists(kept, k -> {overlaps('k', 'b', iou)}), kept, array_append(kept, b)))"
    )
    out = (
        plain.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(*keys, F.explode_outer(F.expr(kept)).alias("b"))
        .where("b is not null")
        .select(*[F.col(c) if c in keys else F.col(f"b.{c}") for c in boxes.columns])
    )
    if hot is None:
        return out
    many, more = split_hot(hot, keys, hot_keys(hot, keys, swept))
    out = out.unionByName(_swept(many, keys, iou))
    return out if more is None else out.unionByName(_suppress_parts(more, keys, iou, swept))


def _swept(boxes: DataFrame, group: list[str], iou: float) -> DataFrame:
    """Suppression of each group in one task."""
    return boxes.groupBy(*group).applyInArrow(_sweep(iou), boxes.schema)


def _sweep(iou: float) -> Callable[[pa.Table], pa.Table]:
    """Go through the boxes, the surest first, and keep each that no kept box near it overlaps.

    Kept boxes stand in a grid by size and position. Few of them fit into the cells near a box, since they overlap little, so
    the work grows with the number of boxes alone.
    """
    steps = math.ceil(math.log2(1 / iou))

    def run(rows: pa.Table) -> pa.Table:
        x1, y1, x2, y2 = (rows[c].to_numpy().astype(np.int64) for c in BOX)
        order = np.lexsort((y2, x2, y1, x1, rows["seq"].to_numpy(), -rows["confidence"].to_numpy()))
        grid: dict[tuple[int, int], dict[tuple[int, int], list[tuple[int, int, int, int]]]] = {}
        stays = []
        for k in order.tolist():
            a, b, c, d = int(x1[k]), int(y1[k]), int(x2[k]), int(y2[k])
            wide, high = c - a, d - b
            if wide <= 0 or high <= 0:
                stays.append(k)  # without an area it overlaps nothing
                continue
            own = (wide.bit_length() - 1, high.bit_length() - 1)
            if not _hit(grid, own, steps, iou, a, b, c, d):
                stays.append(k)
                cell = ((a + c) >> (own[0] + 1), (b + d) >> (own[1] + 1))
                grid.setdefault(own, {}).setdefault(cell, []).append((a, b, c, d))
        return rows.take(pa.array(stays, pa.int64()))

    return run


def _hit(
    grid: dict, own: tuple[int, int], steps: int, iou: float, a: int, b: int, c: int, d: int
) -> bool:
    """Whether a kept box of a like size, in a cell that is near enough, shares more than `iou`."""
    for (sw, sh), cells in grid.items():
        if abs(sw - own[0]) > steps or abs(sh - own[1]) > steps:
            continue
        reach_x, reach_y = c - a + (2 << sw), d - b + (2 << sh)  # twice how far the centres may lie apart
        for cx in range((a + c - reach_x) >> (sw + 1), ((a + c + reach_x) >> (sw + 1)) + 1):
            for cy in range((b + d - reach_y) >> (sh + 1), ((b + d + reach_y) >> (sh + 1)) + 1):
                for p, q, r, s in cells.get((cx, cy), ()):
                    inter = float(max(min(c, r) - max(a, p), 0)) * max(min(d, s) - max(b, q), 0)
                    area = float(c - a) * (d - b) + float(r - p) * (s - q)
                    if inter > iou * (area - inter):
                        return True
    return False


def _in_cells(boxes: DataFrame) -> DataFrame:
    """Boxes with an area, in cells by size and position."""
    return (
        boxes.withColumn("_sw", F.floor(F.log2(F.col("x2") - F.col("x1"))).cast("int"))
        .withColumn("_sh", F.floor(F.log2(F.col("y2") - F.col("y1"))).cast("int"))
        .withColumn("_cx", F.expr("cast(floor((x1 + x2) / 2 / pow(2, _sw)) as bigint)"))
        .withColumn("_cy", F.expr("cast(floor((y1 + y2) / 2 / pow(2, _sh)) as bigint)"))
    )


def _suppress_parts(boxes: DataFrame, keys: list[str], iou: float, swept: int) -> DataFrame:
    """Suppression of groups that fall apart into components of neighbouring cells.

    Cells are nodes, and edges go to the occupied cells that a box of theirs could overlap; boxes of two
    components never overlap. A node is a hash: two cells that share one only join their components.
    """
    solid = "x2 > x1 and y2 > y1"
    placed = stored(_in_cells(boxes.where(solid)))
    cells = ["_sw", "_sh", "_cx", "_cy"]
    node = F.xxhash64(*keys, *cells)
    occupied = stored(placed.select(*keys, *cells).distinct().withColumn("node", node))
    near = _linked_cells(occupied, iou).select(F.col("node").alias("a"), node.alias("b"))
    edges = near.join(occupied.select(F.col("node").alias("b")), "b", "left_semi")
    labels = components(occupied.select("node"), edges)
    parts = placed.withColumn("node", node).join(labels, "node").drop("node", *cells)
    group = [*keys, "root"]
    parts, large = split_hot(stored(parts), group, hot_keys(parts, group, swept))
    out = _swept(parts, group, iou).drop("root").select(*boxes.columns)
    out = out.unionByName(boxes.where(f"not ({solid})"))
    return out if large is None else out.unionByName(_suppress_hot(large.select(*boxes.columns), keys, iou))


def _linked_cells(occupied: DataFrame, iou: float) -> DataFrame:
    """For each cell, all cells that may hold a box overlapping one of its own, from its own width class up."""
    steps = math.ceil(math.log2(1 / iou))

    def cells(at: str, size: str, scale: str) -> Column:
        # the centres of two boxes that meet lie less than both widths apart
        reach = f"(pow(2, {size}) + pow(2, {scale}))"
        low, high = f"({at} * pow(2, {size}) - {reach})", f"(({at} + 1) * pow(2, {size}) + {reach})"
        return F.explode(F.expr(f"sequence(cast(floor({low} / pow(2, {scale})) as bigint), cast(floor({high} / pow(2, {scale})) as bigint))"))

    moved = occupied.withColumns({f"_of{c}": F.col(c) for c in ("_sw", "_sh", "_cx", "_cy")})
    return (
        moved.withColumn("_sw", F.explode(F.sequence(F.col("_of_sw"), F.col("_of_sw") + steps)))
        .withColumn("_sh", F.explode(F.sequence(F.col("_of_sh") - steps, F.col("_of_sh") + steps)))
        .withColumn("_cx", cells("_of_cx", "_of_sw", "_sw"))
        .withColumn("_cy", cells("_of_cy", "_of_sh", "_sh"))
    )


def _suppress_hot(boxes: DataFrame, keys: list[str], iou: float) -> DataFrame:
    """Suppression for components of very many boxes, in rounds over a grid.

    Boxes that overlap enough are alike in size and close in position, so each box falls in a
    cell of its size class and only neighbouring cells matter. In each round the best box of
    a cell is kept when it beats the best of all neighbouring cells, and takes out what it
    overlaps. The result is that of going through all boxes in order.
    """
    whole = F.struct(*boxes.columns)
    order = F.struct((-F.col("confidence")).alias("rank"), F.col("seq"))
    # Of equal boxes only the best can stay, so the copies go before anything is shuffled.
    solid = boxes.where("x2 > x1 and y2 > y1")
    flat = boxes.where("not (x2 > x1 and y2 > y1)")
    best = solid.groupBy(*keys, *BOX).agg(F.min_by(whole, order).alias("b"))
    cells = ["_sw", "_sh", "_cx", "_cy"]
    pending = checkpointed(_in_cells(best.select("b.*")))
    kept = flat
    place = [*keys, *cells]
    while not pending.isEmpty():
        tops = pending.groupBy(*place).agg(F.min_by(whole, order).alias("b"))
        near = _neighbour_cells(tops, keys, iou)
        rivals = tops.select(
            *place, F.struct((-F.col("b.confidence")).alias("rank"), "b.seq").alias("_rival")
        )
        # One rival per cell, so no cell is crowded here.
        met = near.join(rivals, place)
        mine = F.struct((-F.col("b.confidence")).alias("rank"), F.col("b.seq"))
        sure = (
            met.withColumn("_loses", F.col("_rival") < mine)
            .groupBy(*keys, "b")
            .agg(F.max("_loses").alias("_loses"))
            .where("not _loses")
            .select(*keys, "b")
        )
        winners = checkpointed(sure.select("b.*")).select(*boxes.columns)
        kept = kept.unionByName(winners)
        reach = _neighbour_cells(winners.select(*keys, whole.alias("b")), keys, iou)
        # Kept boxes overlap little, so a neighbourhood holds few of them.
        local = reach.groupBy(*place).agg(F.collect_list("b").alias("_kept"))
        after = join_dimension(pending, local, place, "left")
        self_box = "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)"
        hit = f"exists(_kept, k -> {overlaps('k', '_self', iou)})"
        after = (
            after.withColumn("_self", F.expr(self_box))
            .where(F.expr(f"_kept is null or not {hit}"))
            .drop("_kept", "_self")
        )
        pending = checkpointed(after)
    return kept


def _neighbour_cells(tops: DataFrame, keys: list[str], iou: float) -> DataFrame:
    """One row per top and cell that may hold a box overlapping it by more than `iou`."""
    steps = math.ceil(math.log2(1 / iou))

    def scales(size: str) -> Column:
        low = F.floor(F.log2(F.expr(size))).cast("int")
        return F.explode(F.sequence(low - steps, low + steps))

    def cells(low: str, high: str, scale: str) -> Column:
        # Centres lie within half of both sizes less the part that must be shared.
        reach = f"(({high} - {low} + pow(2, {scale} + 1)) / 2 - {iou} * ({high} - {low}))"
        center = f"({low} + {high}) / 2"
        return F.explode(
            F.expr(
                f"sequence(cast(floor(({center} - {reach}) / pow(2, {scale})) as bigint), "
                f"cast(floor(({center} + {reach}) / pow(2, {scale})) as bigint))"
            )
        )

    return (
        tops.select(*keys, "b")
        .withColumn("_sw", scales("b.x2 - b.x1"))
        .withColumn("_sh", scales("b.y2 - b.y1"))
        .withColumn("_cx", cells("b.x1", "b.x2", "_sw"))
        .withColumn("_cy", cells("b.y1", "b.y2", "_sh"))
    )


def removable(
    boxes: DataFrame,
    selective: bool = True,
    min_confidence: float = C.LOGO_REMOVAL_CONFIDENCE,
) -> DataFrame:
    """Boxes to take out: sure ones, and with `selective` only those of sensitive classes."""
    kept = boxes.where(F.col("confidence") >= min_confidence)
    return kept.where("sensitive") if selective else kept


def known_method(method: Column, known: tuple[str, ...], fallback: str) -> Column:
    return F.when(method.isin(*known), method).otherwise(F.lit(fallback))


def clamped(boxes: DataFrame, width: str, height: str, pad: Column | None = None) -> DataFrame:
    """Boxes widened by `pad` and cut at the image edges."""
    by = F.lit(0) if pad is None else pad
    return (
        boxes.withColumn("x1", F.greatest(F.lit(0), F.col("x1") - by))
        .withColumn("y1", F.greatest(F.lit(0), F.col("y1") - by))
        .withColumn("x2", F.least(F.col(width), F.col("x2") + by))
        .withColumn("y2", F.least(F.col(height), F.col("y2") + by))
    )


def removal_plan(
    boxes: DataFrame, method: Column, width: str = "width", height: str = "height"
) -> DataFrame:
    """Removable boxes with the method that will cover them and the padded region it works on."""
    pads = {m: str(C.LOGO_PADDING.get(m, 0)) for m in C.LOGO_METHODS}
    planned = boxes.withColumn("method", known_method(method, C.LOGO_METHODS, C.LOGO_METHOD_FALLBACK))
    pad = F.expr(one_of("method", pads)).cast("int")
    return clamped(planned, width, height, pad)


def region_plan(
    regions: DataFrame, method: Column, width: str = "width", height: str = "height"
) -> DataFrame:
    """Text regions with their method, cut at the image edges; empty regions are left out."""
    planned = regions.withColumn(
        "method", known_method(method, C.REGION_METHODS, C.REGION_METHOD_FALLBACK)
    )
    return clamped(planned, width, height).where("x2 > x1 and y2 > y1")


def redaction_plan(
    tokens: DataFrame,
    entity_docs: DataFrame,
    logos: DataFrame | None,
    key: str = "doc_id",
) -> DataFrame:
    """Everything to cover: all token regions of documents with entities, and the logos.

    `tokens` and `logos` are planned regions; `entity_docs` are the documents with entities.
    """
    columns = [key, "source", "seq", *BOX, "method"]
    text = tokens.join(entity_docs.select(key).distinct(), key, "left_semi")
    planned = text.withColumn("source", F.lit("text")).select(*columns)
    if logos is None:
        return planned
    return planned.unionByName(logos.withColumn("source", F.lit("logo")).select(*columns))


def logo_counts(
    docs: DataFrame,
    boxes: DataFrame,
    selective: bool = True,
    min_confidence: float = C.LOGO_REMOVAL_CONFIDENCE,
    key: str = "doc_id",
) -> DataFrame:
    """Found and removed logos per document, 0 where there are none; one pass over the boxes."""
    gone = F.col("confidence") >= min_confidence
    if selective:
        gone = gone & F.col("sensitive")
    counts = boxes.groupBy(key).agg(
        F.count("*").alias("logos_found"),
        F.count_if(gone).alias("removed_logos"),
        F.avg("confidence").alias("logo_confidence"),
    )
    return (
        docs.select(key)
        .join(counts, key, "left")
        .select(
            key,
            F.coalesce("logos_found", F.lit(0)).alias("logos_found"),
            F.coalesce("removed_logos", F.lit(0)).alias("removed_logos"),
            F.coalesce("logo_confidence", F.lit(0.0)).alias("logo_confidence"),
        )
    )


def display_boxes(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes as shown to people."""
    return boxes.select(
        key,
        "seq",
        F.col("class_name").alias("logo_type"),
        percent(F.col("confidence")).alias("confidence"),
        F.format_string("%d px²", F.col("area")).alias("area"),
        F.format_string("(%d, %d) to (%d, %d)", *BOX).alias("position"),
    )
