"""OCR token tables: filters, fallback decision, combination and page text.

A page normally holds some hundred tokens, so its tokens are gathered into one row and all
decisions are made there, after a single shuffle. Documents with more than `limit` tokens are
processed chunk by chunk instead, and the texts of the chunks are joined in the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import fold_to_array
from palimpsest.operators.ordered import RANGE_ROWS, in_ranges, numbered
from palimpsest.operators.skew import (
    HOT_ROWS,
    chunk_carry,
    hot_keys,
    join_dimension,
    split_hot,
)

STRIP = r"(?U)^\s+|\s+$"
TOKEN = ["seq", "text", "confidence", "x1", "y1", "x2", "y2", "engine", "language"]
# Means are compared after rounding, so that the order of addition cannot decide.
MEAN_DIGITS = 9


def easyocr_tokens(
    raw: DataFrame, threshold: Column | float = C.OCR_THRESHOLD, key: str = "doc_id"
) -> DataFrame:
    """Sure enough tokens, with the box around their four corners and without outer blanks."""

    def edge(reduce: str, axis: str) -> Column:
        return F.expr(f"cast({reduce}(transform(quad, p -> p.{axis})) as int)")

    return raw.where(F.col("confidence") >= threshold).select(
        key,
        "seq",
        F.regexp_replace("text", STRIP, "").alias("text"),
        "confidence",
        edge("array_min", "x").alias("x1"),
        edge("array_min", "y").alias("y1"),
        edge("array_max", "x").alias("x2"),
        edge("array_max", "y").alias("y2"),
        F.lit("easyocr").alias("engine"),
        F.lit("en").alias("language"),
    )


def tesseract_tokens(
    raw: DataFrame, threshold: Column | float = C.OCR_THRESHOLD, key: str = "doc_id"
) -> DataFrame:
    """Sure enough tokens with text; scores come in percent, boxes as corner and size."""
    limit = F.lit(threshold * 100) if isinstance(threshold, (int, float)) else threshold * 100
    stripped = F.regexp_replace("text", STRIP, "")
    return raw.where((F.col("conf") >= limit) & (F.length(stripped) > 0)).select(
        key,
        "seq",
        stripped.alias("text"),
        (F.col("conf") / F.lit(100.0)).alias("confidence"),
        F.col("left_px").alias("x1"),
        F.col("top_px").alias("y1"),
        (F.col("left_px") + F.col("width")).alias("x2"),
        (F.col("top_px") + F.col("height")).alias("y2"),
        F.lit("tesseract").alias("engine"),
        F.lit("eng").alias("language"),
    )


READERS = {"easyocr": easyocr_tokens, "tesseract": tesseract_tokens}


def engine_tokens(
    tables: dict[str, DataFrame],
    engine: str,
    threshold: Column | float = C.OCR_THRESHOLD,
    key: str = "doc_id",
) -> DataFrame | None:
    """Tokens of one engine by name; None when there is no such engine or table."""
    if engine not in tables or engine not in READERS:
        return None
    return READERS[engine](tables[engine], threshold, key)


def two_engines(
    primary: DataFrame | None, fallback: DataFrame | None, key: str = "doc_id"
) -> DataFrame:
    """Bag union of both engines; `slot` is 0 for the primary and 1 for the fallback."""
    parts = [
        t.select(key, F.lit(slot).alias("slot"), *TOKEN)
        for slot, t in ((0, primary), (1, fallback))
        if t is not None
    ]
    if not parts:
        raise ValueError("no engine has a token table")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fallback_decision(tokens: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document whether the fallback engine is asked: nothing, unsure or little text."""
    own = F.col("slot") == 0
    stats = tokens.groupBy(key).agg(
        F.count_if(own).alias("tokens"),
        F.avg(F.when(own, F.col("confidence"))).alias("_mean"),
        F.coalesce(F.sum(F.when(own, F.length("text"))), F.lit(0)).alias("chars"),
        F.count_if(~own).alias("fallback_tokens"),
    )
    return (
        docs.select(key)
        .join(stats, key, "left")
        .select(
            key,
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.round("_mean", MEAN_DIGITS), F.lit(0.0)).alias("mean_confidence"),
            F.coalesce("chars", F.lit(0)).alias("chars"),
            F.coalesce("fallback_tokens", F.lit(0)).alias("fallback_tokens"),
        )
        .withColumn("use_fallback", F.expr(_needs_fallback("tokens", "mean_confidence", "chars")))
    )


def _needs_fallback(tokens: str, mean: str, chars: str) -> str:
    return (
        f"({tokens} = 0 or {mean} < {C.OCR_FALLBACK_CONFIDENCE}D "
        f"or {chars} < {C.OCR_FALLBACK_CHARS})"
    )


def _gathered(tokens: DataFrame, use_fallback: bool, key: str) -> DataFrame:
    """One row per document with `used`, the tokens that count, in combined order."""
    item = F.struct("slot", *TOKEN)
    rows = tokens.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    own = "filter(_all, t -> t.slot = 0)"
    total = "aggregate(own, 0.0D, (s, t) -> s + t.confidence)"
    mean = f"coalesce(round(try_divide({total}, size(own)), {MEAN_DIGITS}), 0.0D)"
    chars = "aggregate(own, 0, (s, t) -> s + length(t.text))"
    ask = _needs_fallback("size(own)", mean, chars) if use_fallback else "false"
    # With both engines the surer tokens come first; with one its own order stays.
    first = "if(_asked and size(own) > 0 and exists(_all, t -> t.slot = 1), -t.confidence, 0.0D)"
    counted = "filter(_all, t -> t.slot = 0 or _asked)"
    ordered = (
        f"transform(array_sort(transform({counted}, t -> named_struct('rank', {first}, "
        "'slot', t.slot, 'seq', t.seq, 'token', t))), r -> r.token)"
    )
    return (
        rows.withColumn("own", F.expr(own))
        .withColumn("_asked", F.expr(ask))
        .withColumn("used", F.expr(ordered))
        .withColumn("used_fallback", F.expr("_asked and exists(_all, t -> t.slot = 1)"))
        .drop("_all", "own", "_asked")
    )


@dataclass(frozen=True)
class Counted:
    """Documents that were counted to have very many tokens, if any."""

    hot: DataFrame | None

    def split(self, tokens: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
        return split_hot(tokens, [key], self.hot)


def count_tokens(tokens: DataFrame, key: str = "doc_id", limit: int = HOT_ROWS) -> Counted:
    """Count once, for all tables made of the same tokens."""
    return Counted(hot_keys(tokens, [key], limit))


def combined_tokens(
    tokens: DataFrame,
    docs: DataFrame,
    use_fallback: bool = True,
    key: str = "doc_id",
    limit: int = HOT_ROWS,
    counted: Counted | None = None,
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Tokens that count, numbered as `place` in combined order."""
    plain, hot = (counted or count_tokens(tokens, key, limit)).split(tokens, key)
    out = (
        _gathered(plain, use_fallback, key)
        .select(key, F.posexplode_outer("used").alias("place", "t"))
        .where("t is not null")
        .select(key, "place", "t.*")
    )
    if hot is None:
        return out
    used = _used_hot(hot, docs, use_fallback, key)
    order = [F.col("_rank"), F.col("slot"), F.col("seq")]
    placed = numbered(used, [key], order, "place", rows)
    placed = placed.withColumn("place", (F.col("place") - 1).cast("int"))
    return out.unionByName(placed.select(*out.columns))


def _used_hot(tokens: DataFrame, docs: DataFrame, use_fallback: bool, key: str) -> DataFrame:
    """Tokens of hot documents that count, with `_rank`, the first key of their order."""
    ids = tokens.select(key).distinct()
    stats = fallback_decision(tokens, ids, key)
    asked = F.col("use_fallback") & F.lit(use_fallback)
    both = asked & (F.col("tokens") > 0) & (F.col("fallback_tokens") > 0)
    return (
        join_dimension(tokens, stats, [key], "inner")
        .where((F.col("slot") == 0) | asked)
        .withColumn("_rank", F.when(both, -F.col("confidence")).otherwise(F.lit(0.0)))
        .withColumn("used_fallback", asked & (F.col("fallback_tokens") > 0))
        .select(key, "slot", *TOKEN, "_rank", "used_fallback")
    )


def page_text(
    tokens: DataFrame,
    docs: DataFrame,
    use_fallback: bool = True,
    key: str = "doc_id",
    limit: int = HOT_ROWS,
    counted: Counted | None = None,
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Text per document: lines from top to bottom, tokens from left to right.

    Columns: key, full_text, tokens, total_confidence, used_fallback. Documents without tokens
    have an empty text.
    """
    plain, hot = (counted or count_tokens(tokens, key, limit)).split(tokens, key)
    center = "cast(floor((t.y1 + t.y2) / 2) as int)"
    placed = (
        "array_sort(transform(used, (t, i) -> named_struct('y1', t.y1, 'x1', t.x1, 'place', i, "
        f"'yc', {center}, 'text', t.text)))"
    )
    element = "struct<line:int,x1:int,yc:int,text:string>"
    before = "try_element_at(laid, -1)"
    new_line = f"({before}.yc <> -1 and abs(t.yc - {before}.yc) > {C.OCR_LINE_PIXELS})"
    step = (
        f"array_append(laid, named_struct('line', case when size(laid) = 0 then 0 "
        f"when {new_line} then {before}.line + 1 else {before}.line end, "
        "'x1', t.x1, 'yc', t.yc, 'text', t.text))"
    )
    lines = fold_to_array(placed, element, "laid", "t", step)
    lines = (
        f"array_sort(transform({lines}, (t, i) -> named_struct('line', t.line, 'x1', t.x1, "
        "'place', i, 'text', t.text)))"
    )
    text = (
        "array_join(transform(_lines, (t, i) -> concat(case when i = 0 then '' "
        "when t.line = get(_lines, i - 1).line then ' ' else '\\n' end, t.text)), '')"
    )
    gathered = (
        _gathered(plain, use_fallback, key)
        .withColumn("_lines", F.expr(lines))
        .select(
            key,
            F.expr(text).alias("full_text"),
            F.size("used").alias("tokens"),
            F.expr("aggregate(used, 0.0D, (s, t) -> s + t.confidence)").alias("total_confidence"),
            "used_fallback",
        )
    )
    ids = docs.select(key)
    if hot is not None:
        used_hot = _used_hot(hot, docs, use_fallback, key)
        ids = ids.join(used_hot.select(key).distinct(), key, "left_anti")
    out = ids.join(gathered, key, "left").select(
        key,
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce("total_confidence", F.lit(0.0)).alias("total_confidence"),
        F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"),
    )
    if hot is None:
        return out
    return out.unionByName(_hot_text(used_hot, key, rows))


def _hot_text(used: DataFrame, key: str, rows: int) -> DataFrame:
    """Page text of documents with very many tokens, built in ranges of about `rows` tokens of the full order."""
    order = [F.col(c) for c in ("y1", "x1", "_rank", "slot", "seq")]
    chunks = in_ranges(used, [F.col(key), *order], "chunk", rows)
    chunks = chunks.withColumn("yc", F.floor((F.col("y1") + F.col("y2")) / 2).cast("int"))
    inner = Window.partitionBy(key, "chunk").orderBy(*order)
    outer = Window.partitionBy(key).orderBy("chunk")

    def breaks(previous: Column, current: Column) -> Column:
        far = (previous != -1) & (F.abs(current - previous) > C.OCR_LINE_PIXELS)
        return F.coalesce(far.cast("int"), F.lit(0))

    flagged = chunks.withColumn("_new", breaks(F.lag("yc").over(inner), F.col("yc")))
    flagged = flagged.withColumn("_line", F.sum("_new").over(inner))
    entry = breaks(F.lag("_last").over(outer), F.col("_first"))
    carry = chunk_carry(
        flagged,
        [key],
        [
            F.min_by("yc", F.struct(*order)).alias("_first"),
            F.max_by("yc", F.struct(*order)).alias("_last"),
            F.sum("_new").alias("_breaks"),
        ],
        [entry.alias("_entry"), "_breaks"],
    )
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        key,
        "chunk",
        (
            F.sum("_entry").over(outer) + F.coalesce(F.sum("_breaks").over(earlier), F.lit(0))
        ).alias("_offset"),
    )
    lined = join_dimension(flagged, carry, [key, "chunk"], "inner")
    lined = lined.withColumn("line", F.col("_line") + F.col("_offset")).drop("chunk")
    parts = in_ranges(lined, [F.col(c) for c in (key, "line", "x1", "y1", "_rank", "slot", "seq")], "chunk", rows)
    item = F.struct("line", "x1", "y1", "_rank", "slot", "seq", "text")
    texts = parts.groupBy(key, F.col("chunk").alias("part")).agg(
        F.array_sort(F.collect_list(item)).alias("_lines"),
        F.count("*").alias("tokens"),
        F.sum("confidence").alias("total_confidence"),
        F.first("used_fallback").alias("used_fallback"),
    )
    by_part = Window.partitionBy(key).orderBy("part")
    joined = (
        "array_join(transform(_lines, (t, i) -> concat(case when i = 0 then '' "
        "when t.line = get(_lines, i - 1).line then ' ' else '\\n' end, t.text)), '')"
    )
    texts = texts.select(
        key,
        "part",
        F.expr(joined).alias("_text"),
        F.expr("get(_lines, 0).line").alias("_first_line"),
        F.expr("try_element_at(_lines, -1).line").alias("_last_line"),
        "tokens",
        "total_confidence",
        "used_fallback",
    )
    previous = F.lag("_last_line").over(by_part)
    lead = (
        F.when(previous.isNull(), "").when(previous == F.col("_first_line"), " ").otherwise("\n")
    )
    pieces = texts.select(
        key, F.struct("part", F.concat(lead, "_text").alias("text")).alias("piece"), "tokens", "total_confidence", "used_fallback"
    )
    # a piece holds many tokens, and the text is one row in the end
    return pieces.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("full_text"),
        F.sum("tokens").alias("tokens"),
        F.sum("total_confidence").alias("total_confidence"),
        F.first("used_fallback").alias("used_fallback"),
    )


def text_blocks(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens that count as exported: text, confidence, bounding box, engine and language, in order."""
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    return tokens.select(key, "place", "text", "confidence", box, "engine", "language")


def ocr_documents(
    tables: dict[str, DataFrame],
    docs: DataFrame,
    primary: str = "easyocr",
    fallback: str = "tesseract",
    threshold: Column | float = C.OCR_THRESHOLD,
    use_fallback: bool = True,
    key: str = "doc_id",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Text and mean confidence per document from the token tables of one or two engines."""
    tokens = all_tokens(tables, primary, fallback, threshold, key)
    return with_mean(page_text(tokens, docs, use_fallback, key, limit))


def all_tokens(
    tables: dict[str, DataFrame],
    primary: str = "easyocr",
    fallback: str = "tesseract",
    threshold: Column | float = C.OCR_THRESHOLD,
    key: str = "doc_id",
) -> DataFrame:
    """Sure enough tokens of both engines."""
    first = engine_tokens(tables, primary, threshold, key)
    second = engine_tokens(tables, fallback, threshold, key)
    return two_engines(first, second, key)


def with_mean(text: DataFrame) -> DataFrame:
    return text.withColumn(
        "average_confidence",
        F.coalesce(F.try_divide("total_confidence", "tokens"), F.lit(0.0)),
    )
