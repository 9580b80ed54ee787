"""Output of external engines: adapters, malformed rows and the join to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import among, empty_array, let, one_of
from palimpsest.functions.text import is_title_case
from palimpsest.operators.scan import FINDING, finding
from palimpsest.operators.skew import join_documents

RAW = "struct<engine:string,raw_label:string,start:int,end:int,score:double,word:string,seq:bigint>"
RAW_FIELDS = ("engine", "raw_label", "start", "end", "score", "word", "seq")

# Name of the label column in each engine's table.
LABEL_COLUMNS = {"presidio": "entity_type", "spacy": "raw_label", "transformers": "entity_group"}


def raw_rows(table: DataFrame, engine: str, key: str = "doc_id") -> DataFrame:
    """One engine's table in the common shape. `word` and `seq` are optional columns."""
    have = table.columns
    optional = {
        "score": F.col("score") if "score" in have else F.lit(None),
        "word": F.col("word") if "word" in have else F.lit(None),
        "seq": F.col("seq") if "seq" in have else F.lit(0),
    }
    return table.select(
        key,
        F.lit(engine).alias("engine"),
        F.col(LABEL_COLUMNS[engine]).alias("raw_label"),
        F.col("start").cast("int").alias("start"),
        F.col("end_pos").cast("int").alias("end"),
        optional["score"].cast("double").alias("score"),
        optional["word"].cast("string").alias("word"),
        optional["seq"].cast("bigint").alias("seq"),
    )


def union_raw(tables: dict[str, DataFrame], key: str = "doc_id") -> DataFrame | None:
    """Bag union of the engines that have a table, in engine order."""
    out = None
    for engine in C.ENGINES:
        if engine in tables:
            rows = raw_rows(tables[engine], engine, key)
            out = rows if out is None else out.unionByName(rows)
    return out


def fault(raw: str, text_chars: str) -> str:
    """Why a row cannot be a finding, or null. `raw` is a prefix of its fields, like `r.`."""
    return (
        f"case when {text_chars} is null then 'unknown document' "
        f"when {raw}raw_label is null then 'no label' "
        f"when {raw}start is null or {raw}end is null then 'no offsets' "
        f"when {raw}engine <> 'spacy' and {raw}score is null then 'no score' "
        f"when {raw}start < 0 then 'start before text' "
        f"when {raw}start >= {raw}end then 'empty span' "
        f"when {raw}end > {text_chars} then 'end after text' end"
    )


def rejected_rows(raw: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Malformed rows with the reason. They take no part in detection."""
    chars = docs.select(key, F.length("text").alias("_chars"))
    return (
        join_documents(raw, chars, [key], "left")
        .withColumn("reason", F.expr(fault("", "_chars")))
        .where("reason is not null")
        .select(key, "engine", "raw_label", "start", "end", "score", "reason")
    )


def ner_confidence(span: str) -> str:
    """Heuristic score of a named entity from its length and capitals, within 0..1."""
    score = (
        f"0.8D + if(length({span}) > 10, 0.1D, 0.0D) + if({is_title_case(span)}, 0.05D, 0.0D)"
        f" - if(length({span}) <= 2, 0.2D, 0.0D)"
    )
    return f"least(greatest({score}, 0.0D), 1.0D)"


def adapt(raws: str, text: str = "text", chars: str | None = None, span: str | None = None) -> str:
    """Raw rows of one document as findings, with each engine's labels, scores and cut.

    `chars` and `span` may stand for the length of the text and the span of row `r`, where the text isn't at hand.
    """
    chars = chars or f"length({text})"
    numbers = " ".join(f"when '{e}' then {i}" for i, e in enumerate(C.ENGINES))
    transformer_label = one_of("upper(r.raw_label)", C.TRANSFORMER_LABELS, "r.raw_label")
    shaped = finding(
        start="r.start",
        engine_no=f"case r.engine {numbers} end",
        rule_no="cast(r.seq as int)",
        end="r.end",
        label=f"case r.engine when 'spacy' then {one_of('r.raw_label', C.NER_LABELS)} "
        f"when 'transformers' then {transformer_label} else r.raw_label end",
        text="if(r.engine = 'transformers', coalesce(r.word, span), span)",
        confidence=f"if(r.engine = 'spacy', {ner_confidence('span')}, r.score)",
        engine=one_of("r.engine", C.ENGINE_NAMES),
        is_sensitive=f"case r.engine when 'spacy' then {among('r.raw_label', C.NER_SENSITIVE)} "
        f"when 'transformers' then {among('upper(r.raw_label)', C.TRANSFORMER_SENSITIVE)} "
        "else true end",
    )
    span = span or f"substring({text}, r.start + 1, r.end - r.start)"
    cut = (
        f"case f.engine when 'spacy' then {C.NER_THRESHOLD}D "
        f"when 'transformer' then {C.TRANSFORMER_THRESHOLD}D else double('-infinity') end"
    )
    valid = f"filter({raws}, r -> {fault('r.', chars)} is null)"
    found = f"transform({valid}, r -> {let(span, 'span', shaped)})"
    wanted = f"filter({found}, f -> f.label is not null and f.confidence >= {cut})"
    return f"cast({wanted} as array<{FINDING}>)"


def of_engines(findings: str, engines: str) -> str:
    """Findings whose engine key is among the array `engines`."""
    names = f"transform({engines}, e -> {one_of('e', C.ENGINE_NAMES)})"
    return let(names, "names", f"filter({findings}, f -> array_contains(names, f.engine))")


def attach_raw(docs: DataFrame, raw: DataFrame, engines: str, key: str = "doc_id") -> DataFrame:
    """Documents with `ext_found`, the findings of their raw rows, beside the text.

    The findings of a document are part of its row, so they are gathered there whatever their number.
    """
    nested = raw.groupBy(key).agg(F.collect_list(F.struct(*RAW_FIELDS)).alias("_raw"))
    found = F.expr(of_engines(adapt(f"coalesce(_raw, {empty_array(RAW)})"), engines))
    return docs.join(nested, key, "left").withColumn("ext_found", found).drop("_raw")
