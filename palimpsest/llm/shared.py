"""What the operators share: word pattern, document keys and tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or one under the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_between"


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: a lost executor costs no earlier step."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression="zstd")
    return spark.read.schema(frame.schema).parquet(path)


def own_names(place: int = 0) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that keep their caller's columns and add helpers of their own, whose names start with ``_``.

    Columns of argument ``place`` that start so are given a name drawn for this call, in the arguments that name them too,
    and have their own name again in the result. So no helper can stand for a column of the caller's.
    """

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(*given, **named):
            docs = given[place]
            drawn = {c: f"own{uuid.uuid4().hex}" for c in docs.columns if c.startswith("_")}
            if not drawn:
                return operator(*given, **named)
            meant = lambda x: drawn.get(x, x) if isinstance(x, str) else tuple(meant(y) for y in x) if isinstance(x, (list, tuple)) else x
            rest = [docs.withColumnsRenamed(drawn) if k == place else meant(x) for k, x in enumerate(given)]
            out = operator(*rest, **{k: meant(x) for k, x in named.items()})
            return out.withColumnsRenamed({new: old for old, new in drawn.items()})

        return run

    return around


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), 0)


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that stand for a document: rows equal in id and text are one document.

    The hash of the text only has to tell rows of one id apart (or rows without an id).
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("__id"),
        F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias("__hash"),
    ]


KEY = ["__id", "__hash"]
