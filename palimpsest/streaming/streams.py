"""Streams: detection and rewriting as documents arrive, and running metrics over runs."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions import constants as C
from palimpsest.operators.engines import RAW_FIELDS
from palimpsest.operators.rewrite import anonymize
from palimpsest.plans.detection import detect


def document_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Documents from files as they appear."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(path)
    )


def anonymized_stream(
    docs: DataFrame,
    engines: tuple[str, ...] = ("presidio", "custom_patterns"),
    threshold: float = C.DOCUMENT_THRESHOLD,
) -> DataFrame:
    """Detection and rewriting of a stream. There is no shuffle and no state."""
    return anonymize(detect(docs, engines=engines, threshold=threshold))


def running_metrics(
    runs: DataFrame, window: str = "1 hour", lateness: str = "2 hours"
) -> DataFrame:
    """Runs, successes and mean time per time window; rows later than `lateness` are dropped."""
    return (
        runs.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window))
        .agg(
            F.count("*").alias("total_processed"),
            F.count_if("success").alias("successful"),
            F.avg(F.when(F.col("success"), F.col("total_time"))).alias("average_time"),
        )
        .select(F.col("window.start").alias("window_start"), "total_processed", "successful", "average_time")
    )


# State in files of each executor, with so many MB of its memory beside the heap. Spark's default is all state (of two versions) on the heap.
STATE_MB = 200
_STATE = "spark.sql.streaming.stateStore."
STATE_ON_DISK = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}rocksdb.maxMemoryUsageMB": str(STATE_MB),
}


def run_available(out: DataFrame, path: str, checkpoint: str, settings: dict[str, str] | None = None) -> StreamingQuery:
    """Process what is there, append it as Parquet and stop. `settings` hold for this stream alone, which keeps those it started with."""
    conf, settings = out.sparkSession.conf, settings or {}
    before = {name: conf.get(name, None) for name in settings}
    writer = (
        out.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    try:
        for name, value in settings.items():
            conf.set(name, value)
        query = writer.start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
    return query


RAW_ROW = "engine string, raw_label string, start int, end int, score double, word string, seq bigint"


#: Documents of a stream are held in this many groups at least. A call of Python per group and micro-batch stands for all its documents.
GROUPS = 128
#: Documents that a group should hold at a time, and that are handed on at once.
GROUP_DOCS = 1_000


def groups_for(held: int) -> int:
    """Groups for so many documents that are held at a time: none grows with the stream."""
    return max(GROUPS, -(-held // GROUP_DOCS))


def with_engine_rows(
    docs: DataFrame, raw: DataFrame, wait: str = "10 minutes", key: str = "doc_id", at: str = "ts", groups: int = GROUPS
) -> DataFrame:
    """A stream of documents (`key`, `text`, `at`) met with a stream of engine rows (as of `union_raw`).

    A document is held until documents of `wait` later have come. It goes on with the engine rows that came by then, as
    `raw`; rows that come later, or for a document that is not held, go on by themselves with `late` set, so none is lost without a
    trace. Documents alone move the clock, so engine rows need no time of their own. The state is the documents within
    `wait` and their engine rows; what is remembered of a document after that is that it has gone, for as long again.

    Documents are held in `groups` by a hash of their key, one state each, so that a call has many of them. A group's state is
    written anew when any of its documents changes, and is in the memory of a task meanwhile: choose the number with `groups_for`, and have the
    state of a large stream on disk (`STATE_ON_DISK`).
    """
    empty_row = F.lit(None).cast(f"struct<{_colons(RAW_ROW)}>")
    left = docs.select(key, F.col(at), F.unix_millis(at).alias("ms"), F.coalesce("text", F.lit("")).alias("text"), empty_row.alias("row"))
    none = [F.lit(None).cast(t).alias(c) for c, t in ((at, "timestamp"), ("ms", "bigint"), ("text", "string"))]
    right = raw.select(key, *none, F.struct(*RAW_FIELDS).alias("row"))
    events = left.unionByName(right).withWatermark(at, wait)
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, late boolean, text string, raw array<struct<{_colons(RAW_ROW)}>>"
    hold = int(docs.sparkSession.sql(f"select cast(interval {wait} as interval day to second) as i").first()["i"].total_seconds() * 1000)
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    return events.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        _held(hold, key), out, "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def _colons(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def _plain_row(row: dict) -> tuple:
    """An engine row in plain numbers, as the state takes them."""
    kinds = {"start": int, "end": int, "seq": int, "score": float}
    return tuple(None if row[f] is None or row[f] != row[f] else kinds.get(f, str)(row[f]) for f in RAW_FIELDS)


def _held(hold: int, key: str) -> Callable:
    """What to do with the events of a group of documents. Its state has of each document its text, whether it has gone, its engine
    rows so far, when it is due, and the time after which that is looked at."""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        out: list[tuple] = []
        touched: dict = {}  # documents with events, and their rows that come late
        if not state.hasTimedOut:
            for batch in batches:
                for k, ms, text, row in zip(batch[key].tolist(), batch["ms"], batch["text"], batch["row"], strict=True):
                    k = None if k != k else k
                    doc = held.setdefault(k, [None, False, [], 0, 0])
                    late = touched.setdefault(k, [])
                    if row is None:
                        if not doc[1]:
                            doc[0], doc[3] = text, int(ms)
                    else:
                        (late if doc[1] else doc[2]).append(_plain_row(row))
        for k, late in touched.items():
            doc = held[k]
            if late:
                out.append((k, True, None, late))
            if doc[0] is None and not doc[1]:
                doc[3] = now + hold if now else 0
            doc[4] = max(doc[3], now + 1)
        for k in [k for k, doc in held.items() if k not in touched and doc[4] < now]:
            text, gone, raw, due, _seen = held[k]
            if gone:
                del held[k]
            elif text is None and due == 0:  # engine rows that came before the clock was known
                held[k][3:] = now + hold, now + hold
            else:
                out.append((k, text is None, text, raw))
                due = max(due, now) + hold
                held[k] = [None, True, [], due, due]
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(doc[4] for doc in held.values()), now + 1))
        else:
            state.remove()
        for first in range(0, len(out), GROUP_DOCS):
            keys, lates, texts, raws = zip(*out[first : first + GROUP_DOCS], strict=True)
            rows = [[dict(zip(RAW_FIELDS, r, strict=True)) for r in raw] for raw in raws]
            yield pd.DataFrame({key: keys, "late": lates, "text": texts, "raw": rows})

    return run


def deliveries(batches: DataFrame, batch_key: str, at: str = "ts", lateness: str = "1 day") -> DataFrame:
    """A stream of batches in which one that is delivered again within `lateness` counts once."""
    return batches.withWatermark(at, lateness).dropDuplicatesWithinWatermark([batch_key])
