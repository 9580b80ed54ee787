"""Text rewriting, the value mapping, reversal and the audit trail."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import empty_array, fold_to_array, let, let_array, one_of, text_literal
from palimpsest.functions.text import DEFAULT_SALT, rewritten

AUTO = "auto"
AUDIT_METHOD = "advanced_anonymization"
OVERLAP_ERROR = "overlapping entities"
REPLACEMENT = "struct<start:int,end:int,label:string,text:string,strategy:string,anonymized:string>"
# Values that are put back one after another; each is a pass over the text.
FEW_VALUES = 16


def chosen_strategy(
    label: str, strategy: str = AUTO, table: dict[str, str] | None = None
) -> str:
    """The given strategy for every label, or with `auto` the label's own."""
    if strategy != AUTO:
        return text_literal(strategy)
    return one_of(label, table or C.DEFAULT_STRATEGIES, text_literal(C.FALLBACK_STRATEGY))


def with_replacements(
    entities: str,
    strategy: str = AUTO,
    table: dict[str, str] | None = None,
    preserve_format: str = "true",
    realistic_names: str = "true",
    salt: str = DEFAULT_SALT,
) -> str:
    """Entities with the strategy applied to each and the value that takes its place."""
    chosen = chosen_strategy("e.label", strategy, table)
    # One strategy for all is a literal, and Spark leaves out the other ways to rewrite.
    how = "get(hows, i)" if strategy == AUTO else chosen
    value = rewritten("e.text", "e.label", how, preserve_format, realistic_names, salt)
    item = (
        "named_struct('start', e.start, 'end', e.end, 'label', e.label, 'text', e.text, "
        f"'strategy', {how}, 'anonymized', {value})"
    )
    if strategy != AUTO:
        return f"transform({entities}, e -> {item})"
    items = let_array(f"transform(es, e -> {chosen})", "hows", f"transform(es, (e, i) -> {item})", REPLACEMENT)
    return let_array(entities, "es", items, REPLACEMENT)


def overlapping(items: str) -> str:
    """Whether any item starts before the one ahead of it has ended."""
    clash = "transform(a, (e, i) -> e.start < coalesce(get(a, i - 1).end, 0))"
    return let(items, "a", f"exists({clash}, bad -> bad)")


def replace_spans(text: str, items: str, value: str = "anonymized") -> str:
    """Text with each span replaced by the item's value. Spans are in order and disjoint."""
    piece = let(
        "coalesce(get(a, i - 1).end, 0)",
        "done",
        f"concat(substring({text}, done + 1, e.start - done), e.{value})",
    )
    tail = f"substr({text}, try_element_at(a, -1).end + 1)"
    built = f"concat(array_join(transform(a, (e, i) -> {piece}), ''), {tail})"
    return let(items, "a", f"if(size(a) = 0, {text}, {built})")


def anonymize(
    docs: DataFrame,
    entities: str = "entities",
    text: str = "text",
    **options: str,
) -> DataFrame:
    """Adds replacements, anonymized_text, entities_processed, success and error_message.

    A document whose entities overlap gets no text at all, never the unmasked one.
    """
    return (
        docs.withColumn("replacements", F.expr(with_replacements(entities, **options)))
        .withColumn("error_message", F.when(F.expr(overlapping("replacements")), OVERLAP_ERROR))
        .withColumn("success", F.col("error_message").isNull())
        .withColumn(
            "anonymized_text", F.expr(f"if(success, {replace_spans(text, 'replacements')}, null)")
        )
        .withColumn("entities_processed", F.expr("if(success, size(replacements), 0)"))
    )


def distinct_values(replacements: str) -> str:
    """Each replaced value once: original, its first replacement, and where it stands first and last."""
    ordered = f"sort_array(transform({replacements}, r -> named_struct('original', r.text, 'start', r.start, 'anonymized', r.anonymized)))"
    firsts = "filter(sequence(0, size(v) - 1), i -> i = 0 or get(v, i - 1).original <> get(v, i).original)"
    item = (
        "named_struct('original', get(v, i).original, 'anonymized', get(v, i).anonymized, 'first_start', get(v, i).start, "
        "'last_start', get(v, coalesce(get(f, k + 1), size(v)) - 1).start)"
    )
    each = let(f"if(size(v) = 0, {empty_array('int')}, {firsts})", "f", f"transform(f, (i, k) -> {item})")
    return let(ordered, "v", each)


def mapping(docs: DataFrame, key: str = "doc_id", one_row_each: bool = False) -> DataFrame:
    """Original and replacement per document; the first occurrence of a value counts.

    Values are told apart inside the row. Where the documents are known to have `one_row_each`, nothing is shuffled.
    """
    rows = docs.select(key, F.explode(F.expr(distinct_values("replacements"))).alias("v")).select(key, "v.*")
    if one_row_each:
        return rows
    return rows.groupBy(key, "original").agg(
        F.min_by("anonymized", "first_start").alias("anonymized"),
        F.min("first_start").alias("first_start"),
        F.max("last_start").alias("last_start"),
    )


def originals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The originals of `mapping` alone, from the entities: for counts, which need no replacement."""
    return docs.select(key, F.explode(F.expr("array_distinct(transform(entities, e -> e.text))")).alias("original"))


def combined_mapping(mappings: DataFrame, order: str = "doc_id") -> DataFrame:
    """One replacement per original over all documents; the last document counts."""
    return mappings.groupBy("original").agg(F.max_by("anonymized", order).alias("anonymized"))


def mapping_export(combined: DataFrame, include_hashes: bool = True) -> DataFrame:
    """Mapping rows for export, with lengths and the hash of the original."""
    columns = [
        F.col("original"),
        F.col("anonymized").alias("anonymized_value"),
        F.length("original").alias("length_original"),
        F.length("anonymized").alias("length_anonymized"),
    ]
    if include_hashes:
        columns.append(F.sha2("original", 256).alias("original_hash"))
    return combined.select(*columns)


def restore_by_offsets(anonymized: str, replacements: str) -> str:
    """The exact original text, from the spans and the values they held."""
    item = (
        "named_struct('start', r.start + shift, 'end', r.start + shift + length(r.anonymized), "
        "'original', r.text, 'shift', shift + length(r.anonymized) - (r.end - r.start))"
    )
    step = let(
        "coalesce(try_element_at(moved, -1).shift, 0)", "shift", f"array_append(moved, {item})"
    )
    span = "struct<start:int,end:int,original:string,shift:int>"
    spans = fold_to_array(replacements, span, "moved", "r", step)
    return replace_spans(anonymized, spans, "original")


def restore_by_mapping(
    docs: DataFrame, mappings: DataFrame, key: str = "doc_id", few: int = FEW_VALUES
) -> DataFrame:
    """Put originals back by value, longest replacement first.

    Exact only where no two originals share a replacement, which `is_reversible` tells. A
    document has at most as many mapping rows as its text has spans. Up to `few` of them are replaced one after
    another; more are found in one pass over the text.
    """
    # Of originals sharing a replacement the one placed last by the right-to-left rewrite counts.
    swapped = mappings.groupBy(key, "anonymized").agg(
        F.min_by("original", "last_start").alias("original"),
        F.max("last_start").alias("placed"),
        F.count("*").alias("n"),
    )
    item = F.struct(
        (-F.length("anonymized")).alias("rank"),
        (-F.col("placed")).alias("placed"),
        F.col("anonymized").alias("anonymized"),
        F.col("original").alias("original"),
    )
    lists = swapped.groupBy(key).agg(
        F.sort_array(F.collect_list(item)).alias("_items"), F.max("n").alias("_shared")
    )
    restored = F.aggregate(
        "_items",
        F.col("anonymized_text"),
        lambda t, m: F.replace(t, m["anonymized"], m["original"]),
    )
    reversible = (F.coalesce("_shared", F.lit(1)) == 1).alias("is_reversible")
    joined = docs.join(lists, key, "left")
    many = F.coalesce(F.size("_items"), F.lit(0)) > few
    one_by_one = joined.where(~many).select(key, F.coalesce(restored, "anonymized_text").alias("restored_text"), reversible)
    values = F.transform("_items", lambda m: F.struct(m["anonymized"].alias("anonymized"), m["original"].alias("original")))
    given = joined.where(many).select(key, reversible, F.col("anonymized_text").alias("_text"), values.alias("_values"))
    schema = T.StructType([*given.select(key, "is_reversible").schema, T.StructField("restored_text", T.StringType())])
    return one_by_one.unionByName(given.mapInArrow(_restored, schema))


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = ([(v["anonymized"], v["original"]) for v in values] for values in batch.column(3).to_pylist())
        texts = [None if t is None else restored_text(t, p) for t, p in zip(batch.column(2).to_pylist(), pairs, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=[*batch.schema.names[:2], "restored_text"])


def restored_text(text: str, pairs: list[tuple[str, str]]) -> str:
    """What replacing each value by its original, pair after pair, makes of the text.

    An automaton finds all values in one pass. They are put back in the order of the pairs, and the surroundings of each
    are looked through once more as they then are: a value that overlaps another, or that comes about only through what was put
    back, would be replaced differently one by one, so then it is done one by one.
    """
    places: dict[str, tuple[int, int]] = {}  # of each value its first pair and its last
    for k, (value, _) in enumerate(pairs):
        if value:
            places[value] = (places[value][0] if value in places else k, k)
    automaton = ahocorasick.Automaton()
    for value, (first, last) in places.items():
        automaton.add_word(value, (first, last, len(value)))
    if not places:
        return text
    automaton.make_automaton()
    found = sorted((end + 1 - size, end + 1, k) for end, (k, _, size) in automaton.iter(text))
    if any(b[0] < a[1] for a, b in itertools.pairwise(found)):
        return _one_by_one(text, pairs)
    # the text as a list of gaps and values in turn; values become originals one by one
    edges = [0, *(x for a, b, _ in found for x in (a, b)), len(text)]
    parts = [text[a:b] for a, b in itertools.pairwise(edges)]
    reach = max(map(len, places)) - 1
    for n in sorted(range(len(found)), key=lambda n: (found[n][2], n)):
        at, k = 2 * n + 1, found[n][2]
        parts[at] = pairs[k][1]
        before, behind = _beside(parts, at, -1, reach), _beside(parts, at, 1, reach)
        first, last = len(before), len(before) + len(parts[at])
        for end, (_, latest, size) in automaton.iter(before + parts[at] + behind):
            touches = end + 1 > first and end + 1 - size < last if last > first else end + 1 > first > end + 1 - size
            if touches and latest > k:
                return _one_by_one(text, pairs)
    return "".join(parts)


def _beside(parts: list[str], at: int, step: int, reach: int) -> str:
    """The `reach` characters before or behind a part."""
    out, at = "", at + step
    while 0 <= at < len(parts) and len(out) < reach:
        out = parts[at] + out if step < 0 else out + parts[at]
        at += step
    return out[-reach:] if step < 0 and reach else out[:reach]


def _one_by_one(text: str, pairs: list[tuple[str, str]]) -> str:
    for value, original in pairs:
        if value:
            text = text.replace(value, original)
    return text


def audit_rows(docs: DataFrame, run_ts: Column, key: str = "doc_id") -> DataFrame:
    """One audit row per document."""
    image = F.col("image_anonymized") if "image_anonymized" in docs.columns else F.lit(False)
    return docs.select(
        run_ts.cast("timestamp").alias("ts"),
        F.col(key).alias("doc_id"),
        "entities_processed",
        (F.coalesce(F.length("anonymized_text"), F.lit(0)) > 0).alias("text_anonymized"),
        image.alias("image_anonymized"),
        F.lit(AUDIT_METHOD).alias("method"),
    )


def audit_tail(audit: DataFrame, n: int = 10) -> DataFrame:
    """The last entries of the audit trail."""
    return audit.orderBy(F.col("ts").desc(), F.col("doc_id").desc()).limit(n)
