"""Detection with findings as rows, for documents with more engine rows than one row can hold.

`detect` keeps a document's findings in its row. Here a document with more than `limit` engine rows
takes another way, with the same result: engine rows meet pieces of the text, findings stay rows, and overlaps are
merged range by range of the positions, with the open winner carried from one range to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import empty_array, fold_to_array, let, let_array, quoted
from palimpsest.functions.recognisers import CUT, Recogniser
from palimpsest.operators.engines import LABEL_COLUMNS, RAW_FIELDS, adapt, union_raw
from palimpsest.operators.fuse import context_window, merge_overlaps, with_context
from palimpsest.operators.ordered import RANGE_ROWS, in_ranges, stored
from palimpsest.operators.scan import FIELDS, FINDING, finding, match_ends, scan_patterns
from palimpsest.operators.skew import HOT_ROWS, join_dimension
from palimpsest.plans.detection import ANALYZER_FIRST_RULE, default_recognisers, detect

# Characters of a piece of text. A span that is longer meets all the pieces it goes through.
PIECE = 1024
# Pieces of a block, which a text is cut into first: finding a place takes going through what is before it.
BLOCK_PIECES = 512
BLOCK = BLOCK_PIECES * PIECE
# Characters of a passage at least, and of the context on each side. A passage is as short as the texts that the scan is quick with.
PASSAGE, MARGIN = 256, C.CONTEXT_WINDOW


@dataclass(frozen=True)
class Found:
    """Findings of each stage as rows: all, the winners of overlaps, and the sure ones of those."""

    findings: DataFrame
    merged: DataFrame
    entities: DataFrame


def detect_rows(
    docs: DataFrame,
    engines: tuple[str, ...] = C.ENGINES,
    raw_tables: dict[str, DataFrame] | None = None,
    recognisers: list[Recogniser] | None = None,
    context: bool = True,
    threshold: float = C.DETECTION_THRESHOLD,
    key: str = "doc_id",
    limit: int = HOT_ROWS,
    rows: int = RANGE_ROWS,
) -> Found:
    """Findings of `docs` as rows of the key and a finding's fields.

    `docs` has one row per document (null keys match no engine row). Documents with up to `limit` engine rows are
    those of `detect`; for the others no task holds more than a range of about `rows` findings.
    """
    docs = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    rules = default_recognisers(engines) if recognisers is None else recognisers
    raw = union_raw({e: t for e, t in (raw_tables or {}).items() if e in engines}, key)
    if raw is None:
        return _in_rows(detect(docs, engines, None, rules, context, threshold, key=key), key)
    raw = stored(raw)  # read by each of the steps below
    crowded = stored(raw.groupBy(key).count().where(F.col("count") > limit).select(key))
    rest = raw.join(crowded, key, "left_anti").withColumnRenamed("end", "end_pos")
    plain = {e: rest.where(F.col("engine") == e).drop("engine").withColumnRenamed("raw_label", LABEL_COLUMNS[e]) for e in raw_tables if e in engines}
    few = _in_rows(detect(docs.join(crowded, key, "left_anti"), engines, plain, rules, context, threshold, key=key), key)
    found = stored(_found(docs.join(crowded, key, "left_semi"), raw.join(crowded, key, "left_semi"), rules, context, key))
    original = found.select(key, *(F.col(f"own.{c}") for c in FIELDS))
    merged = stored(merge_rows(found.select(key, *(F.col(f"scored.{c}") for c in FIELDS)), key, rows))
    sure = merged.where(F.col("confidence") >= threshold)
    return Found(*(a.unionByName(b) for a, b in zip((few.findings, few.merged, few.entities), (original, merged, sure), strict=True)))


def _in_rows(done: DataFrame, key: str) -> Found:
    return Found(*(done.select(key, F.explode_outer(c).alias("f")).where("f is not null").select(key, "f.*") for c in ("findings", "merged", "entities")))


# Rows of arrays are made by explode_outer below: explode would have each array made once more, in a "not empty" filter before it.


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    """Texts in blocks of a fixed number of characters, each with what pieces and passages of it need from its neighbours.

    `_from` is where `_part` starts. Passages of a block start at `_cut`, its first place where texts may be cut, and end at `_next`, that of a
    later block; a block without such a place has none, and the one before it is the longer. `_doc` numbers the texts once they are written.
    """
    at_block = f"substring(text, b * {BLOCK}, {BLOCK + 1})"  # and the character before
    head = f"length(regexp_extract({at_block}, {quoted(rf'(?s)\A.*?{CUT}')}, 0))"
    cuts = f"transform(sequence(0, cast(greatest(_chars - 1, 0) div {BLOCK} as int)), b -> if(b = 0, 0, {let(head, 'n', f'if(n = 0, null, b * {BLOCK} - 1 + n)')}))"
    cut = docs.select(key, F.monotonically_increasing_id().alias("_doc"), F.length("text").alias("_chars"), "text").withColumn("_cuts", F.expr(cuts))
    ends = "transform(_cuts, c -> named_struct('cut', c, 'next', coalesce(array_min(filter(_cuts, n -> n > c)), _chars)))"
    each = cut.withColumn("_cuts", F.expr(ends)).select(key, "_doc", "_chars", "text", F.posexplode_outer("_cuts").alias("_block", "_c"))
    placed = each.select(
        key, "_doc", "_chars", "text", "_block", F.col("_c.cut").alias("_cut"), F.expr("if(_c.cut is null, null, _c.next)").alias("_next"),
        F.expr(f"greatest(_block * {BLOCK} - {MARGIN}, 0)").alias("_from"),
    )
    upto = f"greatest((_block + 1) * {BLOCK} + {PIECE + MARGIN}, coalesce(_next, 0) + {MARGIN})"
    return placed.withColumn("_part", F.expr(f"substring(text, _from + 1, {upto} - _from)")).drop("text")


def _pieces(blocks: DataFrame, key: str) -> DataFrame:
    """Pieces of a fixed number of characters, with the context before each, and behind it a span that starts at its end and the context of that."""
    own = blocks.select(
        key, "_doc", "_chars", "_block", F.expr(f"substring(_part, 1, _block * {BLOCK} - _from)").alias("_lead"),
        F.expr(f"regexp_extract_all(substring(_part, _block * {BLOCK} - _from + 1, {BLOCK + PIECE + MARGIN}), {quoted(f'(?s).{{1,{PIECE}}}')}, 0)").alias("_cut"),
    )
    lead = f"if(i = 0, _lead, right(get(_cut, i - 1), {MARGIN}))"
    near = f"concat({lead}, p, coalesce(get(_cut, i + 1), ''), coalesce(left(get(_cut, i + 2), {MARGIN}), ''))"
    piece = f"named_struct('_piece', _block * {BLOCK_PIECES} + i, '_from', (_block * {BLOCK_PIECES} + i) * {PIECE} - length({lead}), '_text', {near})"
    listed = own.select(key, "_doc", "_chars", F.expr(f"slice(transform(_cut, (p, i) -> {piece}), 1, {BLOCK_PIECES})").alias("_cut"))
    return listed.select(key, "_doc", "_chars", F.explode_outer("_cut").alias("p")).where("p is not null").select(key, "_doc", "_chars", "p.*")


def _passages(blocks: DataFrame, key: str) -> DataFrame:
    """Texts cut where no pattern looks across, into passages of PASSAGE characters or a little more: `_at` is where `text` starts, `_lead` and
    `_tail` are the context around it."""
    shortest = rf"(?s).{{{PASSAGE}}}(?:.*?{CUT}(?=.{{{PASSAGE}}})|.*)|.+"  # what is left is as long, so the next has all of a context
    cut = blocks.where("_cut is not null").select(
        key, "_cut",
        F.expr(f"substring(_part, greatest(_cut - _from - {MARGIN}, 0) + 1, least(_cut - _from, {MARGIN}))").alias("_lead"),
        F.expr(f"substring(_part, _next - _from + 1, {MARGIN})").alias("_tail"),
        F.expr(f"regexp_extract_all(substring(_part, _cut - _from + 1, _next - _cut), {quoted(shortest)}, 0)").alias("_texts"),
    )
    passage = (
        f"named_struct('_at', _cut + get(ends, i) - length(p), 'text', p, '_lead', if(i = 0, _lead, right(get(_texts, i - 1), {MARGIN})), "
        f"'_tail', if(i = size(_texts) - 1, _tail, left(get(_texts, i + 1), {MARGIN})))"
    )
    listed = let_array(match_ends("_texts"), "ends", f"transform(_texts, (p, i) -> {passage})", "struct<_at:int,text:string,_lead:string,_tail:string>")
    listed = cut.select(key, F.expr(listed).alias("_texts"))
    return listed.select(key, F.explode_outer("_texts").alias("p")).where("p is not null").select(key, "p.*")


def _by_passage(blocks: DataFrame, rules: list[Recogniser], numbers: list[int], context: bool, key: str) -> DataFrame:
    """Findings of patterns that look across no cut: each passage is scanned by itself, beside its context."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt evenly: scanning takes far longer than moving
    passages = _passages(blocks, key).repartition(parts, key, "_at")
    own = passages.withColumn("own", F.expr(scan_patterns(rules, numbers=numbers))).withColumn("_wide", F.expr("concat(_lead, text, _tail)"))
    window = context_window("_wide", "(f.start + length(_lead))", "(f.end + length(_lead))")
    scored = own.withColumn("scored", F.expr(with_context("own", window=window) if context else "own"))
    moved = {c: f"transform({c}, f -> {finding('f', start='f.start + _at', end='f.end + _at')})" for c in ("own", "scored")}
    pairs = scored.select(key, *(F.expr(e).alias(c) for c, e in moved.items()))
    return pairs.select(key, F.explode_outer(F.arrays_zip("own", "scored")).alias("z")).where("z is not null").select(key, "z.own", "z.scored")


def _found(docs: DataFrame, raw: DataFrame, rules: list[Recogniser], context: bool, key: str) -> DataFrame:
    """Rows of the key, `own` (a finding) and `scored` (the same with its context score)."""
    blocks = stored(_blocks(docs, key))
    cut = stored(_pieces(blocks, key))
    texts = cut.where("_piece = 0").select(key, "_doc", "_chars")
    analyzer = [r for r in rules if r.engine == "presidio"]
    others = [r for r in rules if r.engine != "presidio"]
    numbered = [*enumerate(analyzer, ANALYZER_FIRST_RULE), *enumerate(others)]

    def with_text(rows: DataFrame, span: str) -> DataFrame:
        """Rows beside the piece of text that their span starts in, or the pieces that it goes through if it is long."""
        short = F.expr(f"{span}.end - {span}.start <= {PIECE}")
        placed = rows.withColumn("_piece", F.expr(f"cast({span}.start div {PIECE} as int)"))
        near = placed.where(short).join(cut, [key, "_piece"])
        columns = [key, span, "_chars", "_from", "_text"]
        long = rows.where(~short).withColumn("_start", F.col(f"{span}.start")).withColumn("_end", F.col(f"{span}.end"))
        at = [key, "_start", "_end"]
        # a span that is not within its text is no finding, and meets none
        spans = long.select(*at).distinct().join(texts, key).where("_start >= 0 and _end <= _chars")
        through = f"sequence(cast(greatest(_start - {MARGIN}, 0) div {PIECE} as int), cast((_end + {MARGIN}) div {PIECE} as int))"
        core = f"named_struct('no', _piece, 'text', substring(_text, _piece * {PIECE} - _from + 1, {PIECE}))"
        pieces = spans.withColumn("_piece", F.explode(F.expr(through))).join(cut.select("_doc", "_piece", F.expr(core).alias("_p")), ["_doc", "_piece"])
        around = pieces.groupBy(*at, "_doc", "_chars").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        whole = around.select(*at, "_chars", F.expr(f"get(_p, 0).no * {PIECE}").alias("_from"), F.expr("array_join(transform(_p, p -> p.text), '')").alias("_text"))
        return near.select(*columns).unionByName(long.join(whole, at).select(*columns))

    # offsets count from the piece's first character for the text, and from the document's for the finding
    window = context_window("_text", "(f.start - _from)", "(f.end - _from)")
    parted = [(n, r) for n, r in numbered if r.parted]
    out = _by_passage(blocks, [r for _, r in parted], [n for n, _ in parted], context, key)
    across = [(n, r) for n, r in numbered if not r.parted]
    if across:  # patterns that may hold anything are looked up in the whole text
        scans = scan_patterns([r for _, r in across], numbers=[n for n, _ in across])
        rows = stored(docs.select(key, F.explode_outer(F.expr(scans)).alias("own")).where("own is not null"))
        if context:
            scored = with_text(rows, "own").withColumn("scored", F.expr(f"get({with_context('array(own)', window=window)}, 0)"))
            rows = scored.select(key, "own", "scored")
        else:
            rows = rows.withColumn("scored", F.col("own"))
        out = out.unionByName(rows)
    met = with_text(raw.select(key, F.struct(*RAW_FIELDS).alias("r")), "r")
    own = adapt("array(r)", chars="_chars", span="substring(_text, r.start - _from + 1, r.end - r.start)")
    rows = met.withColumn("own", F.expr(own)).withColumn("scored", F.expr(with_context("own", window=window) if context else "own"))
    by_engine = rows.select(key, F.explode_outer(F.arrays_zip("own", "scored")).alias("z")).where("z is not null").select(key, "z.own", "z.scored")
    return out.unionByName(by_engine)


def merge_rows(found: DataFrame, key: str = "doc_id", rows: int = RANGE_ROWS) -> DataFrame:
    """The winners among overlapping findings, as `merge_overlaps` chooses them in one row.

    Each range of positions is folded by itself, starting from the winner that the range before leaves open. The open winners are
    first those of ranges folded without one, and ranges are folded again until no open winner changes: twice as a rule,
    since a winner rarely reaches through a whole range. One that does is passed on by what the range holds at best.
    """
    item = F.struct(*FIELDS)
    ranged = in_ranges(found, [F.col(key), *(F.col(c) for c in FIELDS)], "_range", rows)
    parts = ranged.groupBy(key, "_range").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    best = "array_max(transform(_items, f -> named_struct('confidence', f.confidence, 'length', f.end - f.start)))"
    parts = stored(parts.withColumn("_best", F.expr(best)).withColumn("_last_start", F.expr("element_at(_items, -1).start")))
    none = F.lit(None).cast(FINDING)
    folded = F.expr(merge_overlaps(f"concat(if(_open is null, {empty_array(FINDING)}, array(_open)), _items)"))
    ends = stored(parts.select(key, "_range", "_best", "_last_start", none.alias("_open"), F.element_at(_folded_alone(), -1).alias("_last")))
    by_range = [key, "_range"]
    while True:
        opens = _open_winners(ends, key)
        now = stored(ends.drop("_open").join(opens, by_range, "left").join(ends.select(*by_range, F.col("_open").alias("_was")), by_range))
        changed = now.where(~F.col("_open").eqNullSafe(F.col("_was"))).select(*by_range, "_open")
        if changed.isEmpty():
            break
        again = changed.join(parts.select(*by_range, "_items"), by_range).select(*by_range, F.element_at(folded, -1).alias("_new"))
        ends = stored(
            now.join(again, by_range, "left").select(*by_range, "_best", "_last_start", "_open", F.coalesce("_new", "_last").alias("_last"))
        )
    last = F.max("_range").over(Window.partitionBy(key)).alias("_final")
    borders = now.select(*by_range, "_open", last)
    kept = parts.select(*by_range, "_items").join(borders, by_range).withColumn("_kept", folded)
    own = F.expr("if(_range = _final, _kept, slice(_kept, 1, size(_kept) - 1))")  # the next range has the winner left open
    return kept.select(key, F.explode_outer(own).alias("f")).where("f is not null").select(key, "f.*")


def _folded_alone():
    return F.expr(merge_overlaps("_items"))


def _open_winners(ends: DataFrame, key: str) -> DataFrame:
    """The winner that stands open before each range: the last one of the range before, or one from further before that nothing there beats.

    A key has few ranges, whatever its findings; they are gone through in order in one row.
    """
    element = f"struct<_range:int,_open:{FINDING},after:{FINDING}>"
    before = "try_element_at(gone, -1).after"
    passes = (
        f"({before} is not null and e._last_start < {before}.end and (e._best.confidence < {before}.confidence or "
        f"(e._best.confidence = {before}.confidence and e._best.length <= {before}.end - {before}.start)))"
    )
    step = f"array_append(gone, named_struct('_range', e._range, '_open', {before}, 'after', if({passes}, {before}, e._last)))"
    listed = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_range", "_last_start", "_best", "_last"))).alias("_ends"))
    folded = listed.select(key, F.explode_outer(F.expr(fold_to_array("_ends", element, "gone", "e", step))).alias("g"))
    return folded.select(key, "g._range", "g._open")


def analysis_rows(docs: DataFrame, found: Found, key: str = "doc_id") -> DataFrame:
    """Counters per document: found, after merge, after filter, mean confidence; zeros where nothing is found."""
    out = docs.select(key)
    for name, rows in (("total_entities_found", found.findings), ("entities_after_merge", found.merged), ("entities_after_filter", found.entities)):
        counts = rows.groupBy(key).agg(F.count("*").alias(name), *([F.avg("confidence").alias("average_confidence")] if rows is found.entities else []))
        out = join_dimension(out, counts, [key])
    return out.fillna(0)
