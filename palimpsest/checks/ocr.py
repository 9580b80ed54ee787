"""Registered queries: OCR tokens and page text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks.tables import table, with_tables
from palimpsest.operators.ocr import (
    combined_tokens,
    easyocr_tokens,
    engine_tokens,
    fallback_decision,
    ocr_documents,
    tesseract_tokens,
    two_engines,
)
from palimpsest.operators.skew import shared_folder
from palimpsest.sources.sinks import export_ocr

Query = Callable[[SparkSession, str], DataFrame]


def easyocr_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with four slanted corners whose outer edges are the flat box."""
    corners = (
        "array(named_struct('x', x1 + 0.4D, 'y', y1 + 0.7D), "
        "named_struct('x', x2 + 0.9D, 'y', y1 + 0.2D), "
        "named_struct('x', x2 + 0.3D, 'y', y2 + 0.6D), "
        "named_struct('x', x1 + 0.1D, 'y', y2 + 0.1D))"
    )
    return table(spark, sf, "easyocr_flat").select(
        "doc_id", "seq", F.expr(corners).alias("quad"), "text", "confidence"
    )


def ocr_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"easyocr": easyocr_raw(spark, sf), "tesseract": table(spark, sf, "tesseract_raw")}


def page_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()


def both(spark: SparkSession, sf: str) -> DataFrame:
    tables = ocr_tables(spark, sf)
    return two_engines(engine_tokens(tables, "easyocr"), engine_tokens(tables, "tesseract"))


def decision(spark: SparkSession, sf: str) -> DataFrame:
    return fallback_decision(both(spark, sf), page_ids(spark, sf))


def exported_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Text blocks of the JSON export, read back from what was written."""
    ids = page_ids(spark, sf)
    blocks = combined_tokens(both(spark, sf), ids)
    folder = f"{shared_folder(spark)}/ocr"
    export_ocr(ocr_documents(ocr_tables(spark, sf), ids), folder, blocks=blocks)
    block = "place:int,text:string,confidence:double,bbox:array<int>,engine:string,language:string"
    stored = spark.read.schema(f"doc_id bigint, text_blocks array<struct<{block}>>").json(folder)
    rows = stored.select("doc_id", F.explode("text_blocks").alias("b")).select("doc_id", "b.*")
    return rows.withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


def pages(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    out = ocr_documents(ocr_tables(spark, sf), page_ids(spark, sf), **options)
    return out.select(
        "doc_id",
        "full_text",
        "tokens",
        F.round("average_confidence", 6).alias("average_confidence"),
        "used_fallback",
    )


QUERIES: dict[str, Query] = {
    "ocr_corner_tokens": lambda s, d: easyocr_tokens(easyocr_raw(s, d)),
    "ocr_percent_tokens": lambda s, d: tesseract_tokens(table(s, d, "tesseract_raw")),
    "ocr_fallback_decision": lambda s, d: decision(s, d).withColumn(
        "mean_confidence", F.round("mean_confidence", 6)
    ),
    "ocr_combined_tokens": lambda s, d: combined_tokens(both(s, d), page_ids(s, d)).select(
        "doc_id", "place", "text", "confidence", "engine"
    ),
    "ocr_text_blocks": exported_blocks,
    "ocr_page_text": lambda s, d: pages(s, d),
    "ocr_page_text_one_engine": lambda s, d: pages(s, d, use_fallback=False),
    "ocr_page_text_swapped": lambda s, d: pages(s, d, primary="tesseract", fallback="easyocr"),
}


def page_ctes(
    swap: bool = False, fallback: bool = True, cut: str = "0.7::DOUBLE", docs: str | None = None
) -> str:
    """CTEs easy, tess, ids, tokens, decision, used, placed, lines and page."""
    easy, tess = (1, 0) if swap else (0, 1)
    join = f"join {docs} using (doc_id)" if docs else ""
    asked = "true" if fallback else "false"
    return f"""easy as (select doc_id, {easy} as slot, seq, trim(text) as text, confidence, x1, y1, x2, y2,
  'easyocr' as engine, 'en' as language from easyocr_flat {join} where confidence >= {cut}),
tess as (select doc_id, {tess} as slot, seq, trim(text) as text, conf / 100::DOUBLE as confidence,
  left_px as x1, top_px as y1, left_px + width as x2, top_px + height as y2, 'tesseract' as engine,
  'eng' as language from (select * from tesseract_raw {join})
 where conf >= {cut} * 100 and trim(text) <> ''),
ids as (select distinct l_orderkey as doc_id from li),
tokens as (select * from easy union all select * from tess),
decision as (select doc_id, count(*) filter (slot = 0) as tokens,
  coalesce(round(avg(confidence) filter (slot = 0), 9), 0) as mean_confidence,
  coalesce(sum(length(text)) filter (slot = 0), 0)::BIGINT as chars,
  count(*) filter (slot = 1) as fallback_tokens
 from ids left join tokens using (doc_id) group by doc_id),
asked as (select *, tokens = 0 or mean_confidence < 0.8::DOUBLE or chars < 50 as use_fallback from decision),
used as (select t.*, row_number() over (partition by doc_id order by
   case when a.use_fallback and {asked} and a.tokens > 0 and a.fallback_tokens > 0
    then -confidence else 0 end, slot, seq)::INT - 1 as place
 from tokens t join asked a using (doc_id) where slot = 0 or (a.use_fallback and {asked})),
placed as (select *, (y1 + y2) // 2 as yc from used),
broken as (select *, case when abs(yc - lag(yc) over w) > 20 then 1 else 0 end as new_line
 from placed window w as (partition by doc_id order by y1, x1, place)),
lined as (select *, sum(new_line) over (partition by doc_id order by y1, x1, place) as line from broken),
lines as (select doc_id, line, string_agg(text, ' ' order by x1, y1, place) as t
 from lined group by doc_id, line),
texts as (select doc_id, string_agg(t, chr(10) order by line) as full_text from lines group by doc_id),
means as (select doc_id, count(*) as tokens, avg(confidence) as mean from used group by doc_id),
page as (select i.doc_id, coalesce(x.full_text, '') as full_text,
  coalesce(m.tokens, 0) as tokens, round(coalesce(m.mean, 0), 6) as average_confidence,
  coalesce(a.use_fallback and {asked} and a.fallback_tokens > 0, false) as used_fallback
 from ids i left join texts x using (doc_id) left join means m using (doc_id)
 left join asked a using (doc_id))"""


_HEAD = with_tables("easyocr_flat", "tesseract_raw")
_TOKEN = "doc_id, seq, text, confidence, x1, y1, x2, y2, engine, language"

ORACLES: dict[str, str] = {
    "ocr_corner_tokens": f"{_HEAD}, {page_ctes()} select {_TOKEN} from easy",
    "ocr_percent_tokens": f"{_HEAD}, {page_ctes()} select {_TOKEN} from tess",
    "ocr_fallback_decision": f"""{_HEAD}, {page_ctes()} select doc_id, tokens,
 round(mean_confidence, 6) as mean_confidence, chars, fallback_tokens, use_fallback from asked""",
    "ocr_combined_tokens": f"{_HEAD}, {page_ctes()} select doc_id, place, text, confidence, engine from used",
    "ocr_text_blocks": f"""{_HEAD}, {page_ctes()} select doc_id, place, text, confidence,
 x1 || ',' || y1 || ',' || x2 || ',' || y2 as bbox, engine, language from used""",
    "ocr_page_text": f"{_HEAD}, {page_ctes()} select * from page",
    "ocr_page_text_one_engine": f"{_HEAD}, {page_ctes(fallback=False)} select * from page",
    "ocr_page_text_swapped": f"{_HEAD}, {page_ctes(swap=True)} select * from page",
}
