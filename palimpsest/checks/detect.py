"""Registered queries: finding, scoring and merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks import sql as S
from palimpsest.checks.tables import table, with_tables
from palimpsest.functions import constants as C
from palimpsest.functions.recognisers import (
    Recogniser,
    security_id_recognisers,
    security_recognisers,
    standard_recognisers,
)
from palimpsest.operators.engines import rejected_rows, union_raw
from palimpsest.operators.fuse import of_types, with_context
from palimpsest.operators.scan import explode_findings, scan_patterns
from palimpsest.operators.skew import spread, spread_by
from palimpsest.operators.stats import counts_rollup
from palimpsest.plans.detection import detect
from palimpsest.sources.intake import entity_catalogue, unknown_labels

Query = Callable[[SparkSession, str], DataFrame]

PAGES = "pages_text as (select page_id as doc_id, html as text from pages)"
TURNS = (
    "turns as (select conv_id * 1000 + turn as doc_id, text || ' Ref B-' || lpad(cast(conv_id as string), 6, '0')"
    " || ' from 10.0.' || cast(turn % 256 as string) || '.9' as text from conversations)"
)


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with a badge and an address each."""
    values = "concat(text, ' Ref B-', lpad(cast(conv_id as string), 6, '0'), ' from 10.0.', cast(turn % 256 as string), '.9')"
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr(values).alias("text")
    )


def found_in(docs: DataFrame, rules: list[Recogniser], first_rule: int = 0) -> DataFrame:
    found = docs.withColumn("findings", F.expr(scan_patterns(rules, first_rule=first_rule)))
    return explode_findings(found, "findings")


def all_engines(spark: SparkSession, sf: str) -> DataFrame:
    """Detection over the access log with every engine."""
    return detect(
        spread_by(table(spark, sf, "access_log"), "doc_id"),
        raw_tables={
            "presidio": table(spark, sf, "analyzer_raw"),
            "spacy": table(spark, sf, "ner_raw"),
            "transformers": table(spark, sf, "transformer_raw"),
        },
    )


def external_only(spark: SparkSession, sf: str, engine: str, name: str) -> DataFrame:
    done = detect(
        table(spark, sf, "access_log"),
        engines=(engine,),
        recognisers=[],
        raw_tables={engine: table(spark, sf, name)},
    )
    return explode_findings(done, "findings")


def engine_means(spark: SparkSession, sf: str) -> DataFrame:
    done = all_engines(spark, sf)
    return (
        done.select("doc_id", F.explode_outer("engine_confidence").alias("engine", "mean"))
        .where("engine is not null")
        .select("doc_id", "engine", F.round("mean", 6).alias("mean_confidence"))
    )


def counters(spark: SparkSession, sf: str) -> DataFrame:
    done = all_engines(spark, sf)
    return done.select(
        "doc_id",
        F.col("analysis.total_entities_found").cast("bigint").alias("total_entities_found"),
        F.col("analysis.entities_after_merge").cast("bigint").alias("entities_after_merge"),
        F.col("analysis.entities_after_filter").cast("bigint").alias("entities_after_filter"),
        F.round("analysis.average_confidence", 6).alias("average_confidence"),
        F.array_join("engines_used", ",").alias("engines_used"),
    )


def per_row_engines(spark: SparkSession, sf: str) -> DataFrame:
    """Engines and threshold chosen by each document."""
    docs = spread_by(table(spark, sf, "access_log"), "doc_id").withColumn(
        "wanted",
        F.expr("if(doc_id % 2 = 0, array('spacy', 'custom_patterns'), array('presidio'))"),
    )
    docs = docs.withColumn("cut", F.expr("if(doc_id % 3 = 0, 0.95D, 0.8D)"))
    done = detect(
        docs,
        raw_tables={"spacy": table(spark, sf, "ner_raw")},
        row_engines="wanted",
        threshold="cut",
    )
    return explode_findings(done, "entities", arrival=False)


def context(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_by(table(spark, sf, "access_log"), "doc_id")
    rules = standard_recognisers() + security_recognisers()
    found = docs.withColumn("findings", F.expr(scan_patterns(rules)))
    return explode_findings(found.withColumn("scored", F.expr(with_context("findings"))), "scored")


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    raw = union_raw({"spacy": table(spark, sf, "mixed_ner_raw")})
    return rejected_rows(raw, table(spark, sf, "access_log")).drop("score")


def allowed(spark: SparkSession, sf: str) -> DataFrame:
    done = all_engines(spark, sf).withColumn("entities", F.expr(of_types("entities")))
    return explode_findings(done, "entities", arrival=False)


def labels_unknown(spark: SparkSession, sf: str) -> DataFrame:
    entities = explode_findings(all_engines(spark, sf), "entities", arrival=False)
    return unknown_labels(entities, entity_catalogue(spark))


def ip_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Internet addresses in documents: found, scored, merged, filtered and replaced."""
    from palimpsest.operators.rewrite import anonymize

    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    done = detect(docs, engines=("custom_patterns",), recognisers=security_recognisers(("IP_ADDRESS",)))
    return anonymize(done).select("doc_id", "anonymized_text", "entities_processed")


QUERIES: dict[str, Query] = {
    "anonymized_addresses": ip_documents,
    "ip_findings": lambda s, d: found_in(
        spread(table(s, d, "documents")), security_recognisers(("IP_ADDRESS",))
    ),
    "security_findings_access_log": lambda s, d: found_in(
        spread_by(table(s, d, "access_log"), "doc_id"), security_recognisers()
    ),
    "security_findings_documents": lambda s, d: found_in(
        spread(table(s, d, "documents")), security_recognisers()
    ),
    "security_findings_pages": lambda s, d: found_in(spread(page_texts(s, d)), security_recognisers()),
    "conversation_findings": lambda s, d: found_in(
        spread(turn_texts(s, d)), standard_recognisers() + security_recognisers(), 100
    ),
    "security_id_findings": lambda s, d: found_in(
        spread_by(table(s, d, "access_log"), "doc_id"), security_id_recognisers()
    ),
    "standard_findings_documents": lambda s, d: found_in(
        spread(table(s, d, "documents")), standard_recognisers()
    ),
    "standard_findings_access_log": lambda s, d: found_in(
        spread_by(table(s, d, "access_log"), "doc_id"), standard_recognisers()
    ),
    "ner_findings": lambda s, d: external_only(s, d, "spacy", "mixed_ner_raw"),
    "transformer_findings": lambda s, d: external_only(s, d, "transformers", "transformer_raw"),
    "analyzer_findings": lambda s, d: external_only(s, d, "presidio", "analyzer_raw"),
    "rejected_findings": rejected,
    "context_scores": context,
    "all_findings": lambda s, d: explode_findings(all_engines(s, d), "findings"),
    "merged_findings": lambda s, d: explode_findings(all_engines(s, d), "merged", arrival=False),
    "detected_entities": lambda s, d: explode_findings(all_engines(s, d), "entities", arrival=False),
    "document_entities": lambda s, d: explode_findings(
        detect(spread(table(s, d, "documents"))), "entities", arrival=False
    ),
    "entities_per_row_options": per_row_engines,
    "allowed_entities": allowed,
    "engine_confidence": engine_means,
    "analysis_counters": counters,
    "unknown_labels": labels_unknown,
    "label_engine_rollup": lambda s, d: counts_rollup(
        explode_findings(all_engines(s, d), "entities", arrival=False)
    ).select("label", "engine", "entities"),
}

LOG = with_tables("access_log")
ENGINES = with_tables("access_log", "ner_raw", "transformer_raw", "analyzer_raw")
FULL = S.detection(
    ENGINES, "access_log", S.all_rules(), 0.7, "ner_raw", "transformer_raw", "analyzer_raw"
)


def _found(head: str, source: str, rules: list[tuple]) -> str:
    return f"{head}{'' if head.endswith('recursive ') else ','} f as ({S.found_sql(source, rules)}) {S.by_arrival('f')}"


DECLARED = ", ".join(S.lit(t) for t in C.DECLARED_ENTITY_TYPES)
KNOWN = ", ".join(S.lit(t) for t in C.STANDARD_ENTITIES + C.SECURITY_ENTITIES)

_PER_ROW = S.detection(
    with_tables("access_log", "ner_raw"), "access_log", S.all_rules(), 0.0, "ner_raw"
)
# Which engines a document wants decides what is found, so the filter goes into `found`.
_PER_ROW = _PER_ROW.replace("found as (", "found_all as (", 1).replace(
    "scored as (",
    "found as (select * from found_all where case when doc_id % 2 = 0 "
    "then engine in ('spacy', 'custom_patterns') else engine = 'presidio' end),\nscored as (",
    1,
)

ORACLES: dict[str, str] = {
    "anonymized_addresses": S.detection("", "documents", S.ip_rules(), 0.7)
    + ",\n"
    + S.rewritten_ctes("documents", S.auto_sql())
    + " select doc_id, anonymized_text, entities_processed from rewritten",
    "ip_findings": _found("with recursive ", "documents", S.ip_rules()),
    "security_findings_access_log": _found(LOG, "access_log", S.security_rules()),
    "security_findings_documents": _found("with recursive ", "documents", S.security_rules()),
    "security_findings_pages": _found(f"with recursive {PAGES}", "pages_text", S.security_rules()),
    "conversation_findings": _found(
        f"with recursive {TURNS}",
        "turns",
        S.standard_rules() + [(r[0], r[1] + 105, *r[2:]) for r in S.security_rules()],
    ),
    "security_id_findings": _found(LOG, "access_log", S.security_id_rules()),
    "standard_findings_documents": _found("with recursive ", "documents", S.standard_rules()),
    "standard_findings_access_log": _found(LOG, "access_log", S.standard_rules()),
    "ner_findings": with_tables("access_log", "mixed_ner_raw")
    + f", f as ({S.raw_sql('mixed_ner_raw', None, None, 'access_log')}) {S.by_arrival('f')}",
    "transformer_findings": with_tables("access_log", "transformer_raw")
    + f", f as ({S.raw_sql(None, 'transformer_raw', None, 'access_log')}) {S.by_arrival('f')}",
    "analyzer_findings": with_tables("access_log", "analyzer_raw")
    + f", f as ({S.raw_sql(None, None, 'analyzer_raw', 'access_log')}) {S.by_arrival('f')}",
    "rejected_findings": with_tables("access_log", "mixed_ner_raw")
    + """ select doc_id, 'spacy' as engine, raw_label, start, end_pos::INT as "end",
 case when start < 0 then 'start before text' when start >= end_pos then 'empty span'
  else 'end after text' end as reason
from mixed_ner_raw join access_log using (doc_id)
where start < 0 or start >= end_pos or end_pos > length(text)""",
    "context_scores": LOG
    + f""", found as ({S.found_sql('access_log', S.standard_rules() + S.security_rules())}),
scored as ({S.scored_sql('found', 'access_log')})
{S.ENTITY_COLUMNS.format(order='engine_no, rule_no, start').join(('select ', ' from scored'))}""",
    "all_findings": f"{FULL} {S.by_arrival('found')}",
    "merged_findings": f"{FULL} {S.by_position('merged')}",
    "detected_entities": f"{FULL} {S.by_position('entities')}",
    "document_entities": S.detection("", "documents", S.all_rules(), 0.7)
    + " "
    + S.by_position("entities"),
    "entities_per_row_options": _PER_ROW.replace(
        "confidence >= 0.0::DOUBLE",
        "confidence >= case when doc_id % 3 = 0 then 0.95::DOUBLE else 0.8::DOUBLE end",
    )
    + " "
    + S.by_position("entities"),
    "allowed_entities": f"{FULL}, kept as (select * from entities where label in ({DECLARED})) "
    + S.by_position("kept"),
    "engine_confidence": f"""{FULL} select doc_id,
 case engine when 'transformer' then 'transformers' else engine end as engine,
 round(avg(confidence), 6) as mean_confidence from found group by all""",
    "analysis_counters": f"""{FULL} select d.doc_id, coalesce(a.n, 0) as total_entities_found,
 coalesce(b.n, 0) as entities_after_merge, coalesce(c.n, 0) as entities_after_filter,
 round(coalesce(c.mean, 0), 6) as average_confidence,
 'presidio,spacy,transformers,custom_patterns' as engines_used
from access_log d left join (select doc_id, count(*) as n from found group by all) a using (doc_id)
left join (select doc_id, count(*) as n from merged group by all) b using (doc_id)
left join (select doc_id, count(*) as n, avg(confidence) as mean from entities group by all) c
 using (doc_id)""",
    "unknown_labels": f"""{FULL} select label, count(*) as entities from entities
where label not in ({KNOWN}) group by label""",
    "label_engine_rollup": f"""{FULL} select label, engine, count(*) as entities from entities
group by rollup (label, engine)""",
}
