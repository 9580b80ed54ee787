"""Detection over several engines: find, score, merge, filter and count, per document row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import empty_array, text_literal
from palimpsest.functions.recognisers import (
    Recogniser,
    security_id_recognisers,
    security_recognisers,
    standard_recognisers,
)
from palimpsest.operators.engines import RAW, adapt, attach_raw, of_engines, union_raw
from palimpsest.operators.fuse import above, mean_confidence, merge_overlaps, with_context
from palimpsest.operators.scan import FINDING, scan_patterns

ANALYZER_FIRST_RULE = 100


def default_recognisers(engines: tuple[str, ...]) -> list[Recogniser]:
    rules = []
    if "presidio" in engines:
        rules += standard_recognisers() + security_id_recognisers()
    if "custom_patterns" in engines:
        rules += security_recognisers()
    return rules


def detect(
    docs: DataFrame,
    engines: tuple[str, ...] = C.ENGINES,
    raw_tables: dict[str, DataFrame] | None = None,
    recognisers: list[Recogniser] | None = None,
    context: bool = True,
    threshold: str | float = C.DETECTION_THRESHOLD,
    row_engines: str | None = None,
    key: str = "doc_id",
    raw_column: str | None = None,
) -> DataFrame:
    """Adds findings, merged, entities, analysis, engine_confidence and engines_used.

    `raw_tables` holds the output of external engines by engine key; an engine without
    table and without recognisers finds nothing and is not listed as used. `row_engines`
    narrows the engines per row. `raw_column` names an array of engine rows that the documents carry already, as
    those of a stream do.
    """
    rules = default_recognisers(engines) if recognisers is None else recognisers
    tables = {e: t for e, t in (raw_tables or {}).items() if e in engines}
    sources = {r.engine for r in rules} | (set(tables) if raw_column is None else set(engines))
    names = [e for e in C.ENGINES if e in engines and e in sources]
    used = f"cast(array({', '.join(text_literal(n) for n in names)}) as array<string>)"
    if row_engines is not None:
        used = f"array_intersect({used}, {row_engines})"
    analyzer = [r for r in rules if r.engine == "presidio"]
    others = [r for r in rules if r.engine != "presidio"]
    # One scan for all: what is looked up before the patterns is the same for each.
    numbers = [*range(ANALYZER_FIRST_RULE, ANALYZER_FIRST_RULE + len(analyzer)), *range(len(others))]
    found = scan_patterns(analyzer + others, numbers=numbers)
    if row_engines is not None:
        found = of_engines(found, "engines_used")
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "engines_used", F.expr(used)
    )
    raw = union_raw(tables, key)
    scored = with_context("findings") if context else "findings"
    if raw is not None:
        out = attach_raw(out, raw, "engines_used", key)
        found = f"concat({found}, ext_found)"
    if raw_column is not None:
        found = f"concat({found}, {of_engines(adapt(f'coalesce({raw_column}, {empty_array(RAW)})'), 'engines_used')})"
    out = out.withColumn("findings", F.expr(found))
    # Asked for twice, the findings are made in a step of their own, and the next step copies them as bytes and not field by field.
    merged = f"if(size(findings) = 0, {empty_array(FINDING)}, {merge_overlaps(scored)})"
    return (
        out.withColumn("merged", F.expr(merged))
        .withColumn("entities", F.expr(above("merged", threshold)))
        .withColumn("engine_confidence", F.expr(engine_means("findings")))
        .withColumn(
            "analysis",
            F.expr(
                f"named_struct('total_entities_found', size(findings), "
                "'entities_after_merge', size(merged), 'entities_after_filter', size(entities), "
                f"'average_confidence', {mean_confidence('entities')})"
            ),
        )
        .drop("ext_found")
    )


def engine_means(findings: str) -> str:
    """Mean confidence per engine with findings, before context."""
    keys = ", ".join(
        f"named_struct('key', {text_literal(k)}, 'name', {text_literal(v)})"
        for k, v in C.ENGINE_NAMES.items()
    )
    own = f"filter({findings}, f -> f.engine = e.name)"
    pair = (
        f"named_struct('key', e.key, 'n', size({own}), "
        f"'total', aggregate({own}, 0.0D, (t, f) -> t + f.confidence))"
    )
    pairs = f"filter(transform(array({keys}), e -> {pair}), p -> p.n > 0)"
    return (
        f"map_from_entries(transform({pairs}, "
        "p -> named_struct('key', p.key, 'value', p.total / p.n)))"
    )
