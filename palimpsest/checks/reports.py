"""Registered queries: statistics, summaries and report rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks.boxes import LOGO_CTES, logos
from palimpsest.checks.detect import FULL, all_engines
from palimpsest.checks.tables import RUNS, table, with_tables
from palimpsest.operators import stats
from palimpsest.operators.scan import explode_findings
from palimpsest.streaming.streams import running_metrics

Query = Callable[[SparkSession, str], DataFrame]


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return explode_findings(all_engines(spark, sf), "entities", arrival=False)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "runs")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles depend on their order."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def scores_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Median over values with many distinct scores."""
    values = table(spark, sf, "events").select((F.col("value") / 500).alias("score"))
    return rounded(stats.exact_median(values, "score"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "access_log")
    return rounded(stats.document_metrics(docs, entities(spark, sf), logos(spark, sf)))


QUERIES: dict[str, Query] = {
    "entity_statistics": lambda s, d: rounded(stats.entity_statistics(entities(s, d))),
    "exact_median": scores_of_all,
    "entities_by_label": lambda s, d: stats.counts_by(entities(s, d), "label"),
    "entities_by_engine": lambda s, d: stats.counts_by(entities(s, d), "engine"),
    "entity_type_share": lambda s, d: rounded(stats.type_share(entities(s, d))),
    "entity_type_analysis": lambda s, d: rounded(
        stats.entity_type_analysis(entities(s, d), runs(s, d))
    ),
    "document_metrics": metrics,
    "entities_displayed": lambda s, d: stats.display_entities(entities(s, d)),
    "processing_statistics": lambda s, d: rounded(stats.processing_statistics(runs(s, d)), 4),
    "average_processing_time": lambda s, d: rounded(stats.average_processing_time(runs(s, d))),
    "batch_summary": lambda s, d: rounded(stats.batch_summary(runs(s, d))),
    "request_summary": lambda s, d: rounded(stats.request_summary(runs(s, d)), 4),
    "dashboard_summary": lambda s, d: rounded(stats.dashboard_summary(runs(s, d))),
    "stage_times": lambda s, d: stats.stage_times(runs(s, d)),
    "run_history": lambda s, d: stats.history(runs(s, d)),
    "run_timeline": lambda s, d: stats.timeline(runs(s, d)).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ),
    "hourly_metrics": lambda s, d: rounded(running_metrics(runs(s, d))).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    ),
    "failed_runs": lambda s, d: runs(s, d).where("not success").select("doc_id", "filename"),
}

_RUNS = with_tables("runs")
_OK = "filter (success)"
_MEANS = ", ".join(
    f"round(coalesce(avg({s}_time) {_OK}, 0), 4) as average_{s}_time"
    for s in ("total", "ocr", "pii", "logo", "anonymization")
)
_SPREAD = ", ".join(
    f"round(avg(coalesce({c}, 0)) {_OK}, 4) as average_{c}, "
    f"round(stddev_pop(coalesce({c}, 0)) {_OK}, 4) as {c}_std"
    for c in ("ocr_confidence", "pii_confidence")
)

ORACLES: dict[str, str] = {
    "entity_statistics": f"""{FULL} select count(*) as total_entities,
 count(distinct label) as unique_labels, round(avg(confidence), 6) as mean_confidence,
 round(stddev_pop(confidence), 6) as std_confidence, round(min(confidence), 6) as min_confidence,
 round(max(confidence), 6) as max_confidence, count(*) filter (is_sensitive) as sensitive_entities,
 round(median(confidence), 6) as median_confidence from entities""",
    "exact_median": "select round(median(value / 500), 6) as median from events",
    "entities_by_label": f"{FULL} select label, count(*) as entities from entities group by label",
    "entities_by_engine": f"{FULL} select engine, count(*) as entities from entities group by engine",
    "entity_type_share": f"""{FULL} select label, count(*) as entities,
 round(count(*) / sum(count(*)) over (), 6) as share from entities group by label""",
    "entity_type_analysis": f"""{FULL.replace('with recursive ', 'with recursive runs as (' + RUNS + '), ', 1)},
good as (select * from runs where success), mine as (select label, count(*) as entities
 from entities where doc_id in (select doc_id from good) group by label)
select label, entities, round((select sum(entities) from mine) / (select count(*) from good), 6)
  as average_entities_per_document,
 label = (select label from mine order by entities desc, label limit 1) as most_common from mine""",
    "document_metrics": f"""{FULL.replace('with recursive ', with_tables('detections_raw') + ', ' + LOGO_CTES + ', ', 1)}
select d.doc_id, coalesce(e.n, 0) as entities_found, round(coalesce(e.c, 0), 6) as pii_confidence,
 coalesce(l.n, 0) as logos_found, round(coalesce(l.c, 0), 6) as logo_confidence
from access_log d
left join (select doc_id, count(*) as n, avg(confidence) as c from entities group by all) e using (doc_id)
left join (select doc_id, count(*) as n, avg(confidence) as c from logos group by all) l using (doc_id)""",
    "entities_displayed": f"""{FULL} select doc_id,
 row_number() over (partition by doc_id order by start)::INT - 1 as seq, text, label as type,
 round_even(confidence * 100, 0)::INT || '%' as confidence, engine, start || '-' || "end" as position,
 case when is_sensitive then 'yes' else 'no' end as sensitive from entities""",
    "processing_statistics": f"""{_RUNS} select count(*) as total_documents,
 count(*) {_OK} as successful_documents,
 round(count(*) {_OK} * 100.0::DOUBLE / count(*), 4) as success_rate,
 sum(entities_found) {_OK}::BIGINT as total_entities_found,
 sum(logos_found) {_OK}::BIGINT as total_logos_found, {_MEANS},
 round(count(*) {_OK} / sum(total_time) {_OK}, 4) as throughput_docs_per_second, {_SPREAD} from runs""",
    "average_processing_time": f"{_RUNS} select round(avg(total_time), 6) as average_processing_time from runs",
    "batch_summary": f"""{_RUNS} select count(*) as total_documents, count(*) {_OK} as successful,
 count(*) filter (not success) as failed, round(avg(total_time) {_OK}, 6) as average_processing_time,
 sum(entities_found) {_OK}::BIGINT as total_entities_found,
 sum(logos_found) {_OK}::BIGINT as total_logos_found from runs""",
    "request_summary": f"""{_RUNS} select count(*) as total_documents,
 count(*) {_OK} as successful_documents, count(*) filter (not success) as failed_documents,
 round(sum(total_time), 4) as total_processing_time,
 round(sum(total_time) / count(*), 4) as average_processing_time from runs""",
    "dashboard_summary": f"""{_RUNS} select count(*) as total_processed, count(*) {_OK} as successful,
 round(count(*) {_OK} * 100.0::DOUBLE / count(*), 6) as success_rate,
 round(avg(total_time) {_OK}, 6) as average_time from runs""",
    "stage_times": f"""{_RUNS} select doc_id, 'OCR' as stage, ocr_time as seconds from runs
union all select doc_id, 'PII Detection', pii_time from runs
union all select doc_id, 'Logo Detection', logo_time from runs
union all select doc_id, 'Anonymization', anonymization_time from runs""",
    "run_history": f"""{_RUNS} select filename, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp,
 case when success then 'Success' else 'Failed' end as status,
 case when success then entities_found else 0 end as entities,
 case when success then logos_found else 0 end as logos,
 case when success then printf('%.2f', total_time) else 'N/A' end as seconds from runs""",
    "run_timeline": f"""{_RUNS} select filename, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, success,
 case when success then total_time else 0 end as total_time from runs""",
    "hourly_metrics": f"""{_RUNS} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')
  as window_start, count(*) as total_processed, count(*) {_OK} as successful,
 round(avg(total_time) {_OK}, 6) as average_time from runs group by 1""",
    "failed_runs": f"{_RUNS} select doc_id, filename from runs where not success",
}
