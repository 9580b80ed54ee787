"""Registered queries: rules, rewriting, mapping, reversal and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks import sql as S
from palimpsest.checks.tables import table, with_tables
from palimpsest.functions import constants as C
from palimpsest.operators.ordered import stored
from palimpsest.operators.rewrite import (
    anonymize,
    audit_rows,
    audit_tail,
    combined_mapping,
    mapping,
    mapping_export,
    originals,
    restore_by_mapping,
    restore_by_offsets,
)
from palimpsest.operators.rules import MaskingRule, apply_rule_table, apply_rules
from palimpsest.operators.scan import explode_findings
from palimpsest.operators.skew import spread, spread_by
from palimpsest.operators.stats import anonymization_report
from palimpsest.plans.detection import detect

Query = Callable[[SparkSession, str], DataFrame]

STRATEGIES = (
    "mask", "replace", "replace_realistic", "replace_format", "replace_partial",
    "replace_domain", "replace_network", "hash", "encrypt", "no_such_strategy",
)
RUN_TS = "timestamp'2024-01-01 00:00:00'"

RULES = [
    MaskingRule("ACCESS_CARD", "lower_threshold", 0.9),
    MaskingRule("SECURITY_ID", "whitelist", values=("B-000007",)),
    MaskingRule("ROOM_NUMBER", "skip"),
    MaskingRule("SSN", "lower_threshold", min_confidence=0.99),
    MaskingRule("PERSON", "whitelist", values=("Aino Okafor", "Bela Tanaka")),
    MaskingRule("BADGE_NUMBER", "blacklist", values=("B-000010", "B-000020")),
    MaskingRule("ACCESS_CARD", "keep"),
]


def log_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the access log, names included, at the document threshold."""
    return detect(
        spread_by(table(spark, sf, "access_log"), "doc_id"),
        engines=C.DOCUMENT_ENGINES,
        raw_tables={"spacy": table(spark, sf, "ner_raw")},
        threshold=C.DOCUMENT_THRESHOLD,
    )


def rewritten(strategy: str, **options: object) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        done = anonymize(log_entities(spark, sf), strategy=strategy, **options)
        return done.select("doc_id", "anonymized_text", "entities_processed")

    return query


def log_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return anonymize(log_entities(spark, sf))


def documents_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return anonymize(detect(docs, engines=C.DOCUMENT_ENGINES, threshold=C.DOCUMENT_THRESHOLD))


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    done = log_entities(spark, sf).withColumn("entities", F.expr(apply_rules("entities", RULES)))
    return explode_findings(done, "entities", arrival=False).drop("seq")


def rule_rows(spark: SparkSession) -> DataFrame:
    rows = [
        (i, r.entity_type, r.strategy, r.min_confidence, list(r.values)) for i, r in enumerate(RULES)
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, entity_type string, strategy string, min_confidence double, "
        "values array<string>",
    )


def ruled_by_table(spark: SparkSession, sf: str) -> DataFrame:
    entities = explode_findings(log_entities(spark, sf), "entities", arrival=False).drop("seq")
    return apply_rule_table(entities, rule_rows(spark))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_rows(log_rewritten(spark, sf), F.expr(RUN_TS))


def last_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows stamped with the time of their event; the last ten."""
    times = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("at")
    )
    stamped = log_rewritten(spark, sf).join(times, "doc_id")
    return audit_tail(audit_rows(stamped, F.col("at"))).select(
        "doc_id", "entities_processed", "text_anonymized", "image_anonymized", "method"
    )


def restored(spark: SparkSession, sf: str) -> DataFrame:
    return documents_rewritten(spark, sf).select(
        "doc_id",
        F.expr(restore_by_offsets("anonymized_text", "replacements")).alias("restored_text"),
    )


def rewritten_once(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    """Rewritten texts that several tables are made of: computed once, written and read back."""
    done = anonymize(log_entities(spark, sf), strategy=strategy)
    return stored(done.select("doc_id", "anonymized_text", "replacements"))


def restored_log(spark: SparkSession, sf: str) -> DataFrame:
    """Reversal by the value mapping, where replacements are hashes and so do not clash."""
    done = rewritten_once(spark, sf, "hash")
    return restore_by_mapping(done, mapping(done))


def reversible(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents the usual strategies leave reversible by value."""
    done = rewritten_once(spark, sf, "replace")
    return restore_by_mapping(done, mapping(done)).select("doc_id", "is_reversible")


def report(spark: SparkSession, sf: str) -> DataFrame:
    out = anonymization_report(table(spark, sf, "runs"), originals(log_entities(spark, sf)))
    return (
        out.withColumn("total_processing_time", F.round("total_processing_time", 4))
        .withColumn("average_processing_time", F.round("average_processing_time", 6))
        .withColumn("anonymization_methods_used", F.array_join("anonymization_methods_used", ","))
    )


QUERIES: dict[str, Query] = {
    **{f"anonymized_{s}": rewritten(s) for s in STRATEGIES},
    "anonymized_access_log": rewritten("auto"),
    "anonymized_documents": lambda s, d: documents_rewritten(s, d).select(
        "doc_id", "anonymized_text", "entities_processed"
    ),
    "anonymized_declared_strategies": rewritten("auto", table=C.DECLARED_STRATEGIES),
    "anonymized_without_format": rewritten("auto", preserve_format="false"),
    "anonymized_without_names": rewritten("auto", realistic_names="false"),
    "value_mapping": lambda s, d: mapping(log_rewritten(s, d), one_row_each=True).select(
        "doc_id", "original", "anonymized"
    ),
    "combined_mapping": lambda s, d: combined_mapping(mapping(log_rewritten(s, d), one_row_each=True)),
    "mapping_export": lambda s, d: mapping_export(combined_mapping(mapping(log_rewritten(s, d), one_row_each=True))),
    "masking_rules": ruled,
    "masking_rule_table": ruled_by_table,
    "audit_trail": lambda s, d: audit(s, d).withColumn("ts", F.col("ts").cast("string")),
    "audit_tail": last_audit,
    "restored_documents": restored,
    "restored_by_mapping": restored_log,
    "reversible_documents": reversible,
    "anonymization_report": report,
}

_ENTITIES = S.detection(
    with_tables("access_log", "ner_raw", "runs"),
    "access_log",
    S.all_rules(),
    C.DOCUMENT_THRESHOLD,
    "ner_raw",
)


def _rewritten(value: str) -> str:
    return (
        f"{_ENTITIES},\n{S.rewritten_ctes('access_log', value)} "
        "select doc_id, anonymized_text, entities_processed from rewritten"
    )


_AUTO = f"{_ENTITIES},\n{S.rewritten_ctes('access_log', S.auto_sql())}"
_MAPPING = (
    f"{_AUTO},\nmapped as (select doc_id, text as original, arg_min(anonymized, start) as anonymized "
    "from replaced group by doc_id, text),\n"
    "combined as (select original, arg_max(anonymized, doc_id) as anonymized from mapped group by original)"
)
_DOCUMENTS = (
    S.detection("", "documents", S.all_rules(), C.DOCUMENT_THRESHOLD)
    + ",\n"
    + S.rewritten_ctes("documents", S.auto_sql())
)
_KEPT = """select doc_id, text, label, start, "end"::INT as "end",
 case when label = 'BADGE_NUMBER' and text in ('B-000010', 'B-000020') then 1::DOUBLE
  else confidence end as confidence, engine, context_score, is_sensitive
from entities where label <> 'ROOM_NUMBER' and not (label = 'SSN' and confidence < 0.99::DOUBLE)
 and not (label = 'PERSON' and text in ('Aino Okafor', 'Bela Tanaka'))
 and not (label = 'SECURITY_ID' and text = 'B-000007')"""
_FORMATTED = {
    k: ("replace" if v == "replace_format" else v) for k, v in C.DEFAULT_STRATEGIES.items()
}
_NAMED = {k: ("replace" if v == "replace_realistic" else v) for k, v in C.DEFAULT_STRATEGIES.items()}

ORACLES: dict[str, str] = {
    **{f"anonymized_{s}": _rewritten(S.strategy_sql(s)) for s in STRATEGIES},
    "anonymized_access_log": f"{_AUTO} select doc_id, anonymized_text, entities_processed from rewritten",
    "anonymized_documents": f"{_DOCUMENTS} select doc_id, anonymized_text, entities_processed from rewritten",
    "anonymized_declared_strategies": _rewritten(S.auto_sql(C.DECLARED_STRATEGIES)),
    "anonymized_without_format": _rewritten(S.auto_sql(_FORMATTED)),
    "anonymized_without_names": _rewritten(S.auto_sql(_NAMED)),
    "value_mapping": f"{_MAPPING} select doc_id, original, anonymized from mapped",
    "combined_mapping": f"{_MAPPING} select original, anonymized from combined",
    "mapping_export": f"""{_MAPPING} select original, anonymized as anonymized_value,
 length(original)::INT as length_original, length(anonymized)::INT as length_anonymized,
 sha256(original) as original_hash from combined""",
    "masking_rules": f"{_ENTITIES} {_KEPT}",
    "masking_rule_table": f"{_ENTITIES} {_KEPT}",
    "audit_trail": f"""{_AUTO} select '2024-01-01 00:00:00' as ts, doc_id, entities_processed,
 length(anonymized_text) > 0 as text_anonymized, false as image_anonymized,
 'advanced_anonymization' as method from rewritten""",
    "audit_tail": f"""{_AUTO} select doc_id, entities_processed,
 length(anonymized_text) > 0 as text_anonymized, false as image_anonymized,
 'advanced_anonymization' as method
from rewritten join events on event_id = doc_id order by ts desc, doc_id desc limit 10""",
    "restored_documents": "select doc_id, text as restored_text from documents",
    "restored_by_mapping": with_tables("access_log")
    + " select doc_id, text as restored_text, true as is_reversible from access_log",
    "reversible_documents": f"""{_ENTITIES} select d.doc_id, coalesce(ok, true) as is_reversible
from access_log d left join (select doc_id, count(distinct text) = count(distinct label) as ok
 from entities group by doc_id) e using (doc_id)""",
    "anonymization_report": f"""{_MAPPING} select r.*, u.*, m.* from (
 select count(*) as total_documents_processed, count(*) filter (success) as successful_operations,
  sum(entities_processed)::BIGINT as total_entities_anonymized,
  round(sum(total_time), 4) as total_processing_time,
  round(sum(total_time) / count(*), 6) as average_processing_time,
  sum(entities_processed) > 0 as anonymization_performed, true as audit_trail_maintained,
  true as format_preservation from runs) r,
 (select count(distinct original) as total_unique_values_anonymized from mapped) u,
 (select string_agg(method, ',' order by method) as anonymization_methods_used
  from (select distinct method from runs)) m""",
}
