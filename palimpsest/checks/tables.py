"""Derived input tables. The same SQL text runs on Spark and on the checking database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "split_part('Aino,Bela,Chidi,Dalia,Enzo,Freja,Goran,Hana', ',', cast(user_id % 8 as int) + 1)"
FAMILY = (
    "split_part('Okafor,Lindqvist,Marek,Tanaka,Novak,Sorel,Ibarra,Weiss', ',', "
    "cast(event_id % 8 as int) + 1)"
)

ACCESS_LOG = f"""
select event_id as doc_id, 'evt' || cast(event_id % 20 as string) as source,
 'Visitor: ' || {FIRST} || ' ' || {FAMILY}
 || ', staff id EMP' || lpad(cast(user_id as string), 6, '0') || ', passed the gate with B-'
 || lpad(cast(event_id as string), 6, '0')
 || case cast(event_id % 6 as int)
  when 0 then ' for server SYS-PROD-' || lpad(cast(user_id % 100 as string), 2, '0')
   || ' from host 10.' || cast(user_id % 256 as string) || '.'
   || cast(event_id % 256 as string) || '.7.'
  when 1 then ' and token AC-' || lpad(cast(event_id as string), 6, '0') || ' as in POL-SEC-'
   || cast(2000 + user_id % 30 as string) || '.'
  when 2 then ' to ROOM-' || cast(100 + user_id % 900 as string) || 'B next to '
   || cast(100 + event_id % 900 as string) || ' office, log AUD-2024-'
   || lpad(cast(event_id as string), 8, 'X') || '.'
  when 3 then ' mail user' || cast(user_id as string) || '@mail.example.org or call (555) '
   || cast(100 + user_id % 900 as string) || '-'
   || lpad(cast(event_id % 10000 as string), 4, '0') || '.'
  when 4 then ' key CRED-' || lpad(cast(event_id as string), 6, '0')
   || '-Q on device 02:4c:6e:80:9a:' || lpad(cast(event_id % 90 as string), 2, '0') || '.'
  else ' insured 321-54-' || lpad(cast(event_id % 10000 as string), 4, '0')
   || ' paid by card 5105-1051-0510-' || lpad(cast(user_id % 10000 as string), 4, '0') || '.'
  end as text
from events"""

NER_RAW = f"""
select event_id as doc_id, 'PERSON' as raw_label, 10 as start,
 10 + length({FIRST}) + 1 + length({FAMILY}) as end_pos
from events"""

TRANSFORMER_RAW = f"""
select event_id as doc_id,
 split_part('PER,ORG,LOC,MISC,XYZ', ',', cast(user_id % 5 as int) + 1) as entity_group, 10 as start,
 10 + length({FIRST}) as end_pos,
 cast(60 + event_id % 40 as double) / cast(100 as double) as score
from events"""

ANALYZER_RAW = f"""
select event_id as doc_id, case when user_id % 2 = 0 then 'PERSON' else 'TITLE' end as entity_type,
 case when user_id % 2 = 0 then 10 else 0 end as start,
 case when user_id % 2 = 0 then 10 + length({FIRST}) else 7 end as end_pos,
 cast(50 + event_id % 50 as double) / cast(100 as double) as score
from events"""

# Named-entity rows over several labels, with some rows that no document can hold.
MIXED_NER_RAW = f"""
select event_id as doc_id,
 split_part('PERSON,ORG,GPE,DATE,TIME,MONEY,CARDINAL,ORDINAL,NORP', ',', cast(user_id % 9 as int) + 1)
  as raw_label,
 case when event_id % 13 = 0 then -3 else 10 end as start,
 case when event_id % 17 = 0 then 2000 when event_id % 19 = 0 then 10
  when event_id % 7 = 0 then 12 else 10 + length({FIRST}) end as end_pos
from events"""

LI = """
select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_shipdate) as int) as rn
from lineitem"""

EASYOCR = """
select l_orderkey as doc_id, rn as seq,
 l_returnflag || l_linestatus || cast(l_partkey as string) as text,
 cast(50 + (l_partkey * 7 + rn) % 50 as double) / cast(100 as double) as confidence,
 cast((l_partkey % 8) * 60 as int) as x1, cast((l_suppkey % 6) * 17 as int) as y1,
 cast((l_partkey % 8) * 60 + 50 as int) as x2, cast((l_suppkey % 6) * 17 + 12 + rn % 3 as int) as y2
from li"""

TESSERACT = """
select l_orderkey as doc_id, rn as seq,
 case when l_partkey % 13 = 0 then ' ' else ' ' || l_linestatus || cast(l_suppkey as string) end
  as text,
 cast((l_partkey * 3) % 102 as int) - 1 as conf, cast((l_partkey % 8) * 60 as int) as left_px,
 cast((l_suppkey % 6) * 17 as int) as top_px, 50 as width, 12 as height
from li"""

DETECTIONS = """
select l_orderkey as doc_id, rn as seq, cast(l_partkey % 12 as int) as class_id,
 cast(50 + (l_suppkey * 11 + rn) % 50 as double) / cast(100 as double) as confidence,
 cast(l_partkey % 40 - 10 as int) as x1, cast(l_suppkey % 30 - 5 as int) as y1,
 cast(l_partkey % 40 + 40 as int) as x2, cast(l_suppkey % 30 + 35 as int) as y2
from li"""

# Entity and logo counts and confidences of a run come from the same columns.
RUNS = """
select event_id as doc_id, concat('file_', cast(event_id as string), '.jpg') as filename,
 cast(ts as timestamp) as ts,
 event_type <> 'error' as success, value as total_time, value * cast(0.5 as double) as ocr_time,
 value * cast(0.25 as double) as pii_time, value * cast(0.125 as double) as logo_time,
 value * cast(0.125 as double) as anonymization_time,
 cast(user_id % 7 as int) as entities_found, cast(user_id % 3 as int) as logos_found,
 case when user_id % 10 = 0 then null else cast(user_id % 100 as double) / cast(100 as double) end
  as ocr_confidence,
 case when user_id % 7 = 0 then null else cast(event_id % 100 as double) / cast(100 as double) end
  as pii_confidence,
 split_part('advanced,auto,mask', ',', cast(event_id % 3 as int) + 1) as method,
 cast(user_id % 7 as int) as entities_processed
from events"""

TABLES = {
    "access_log": (ACCESS_LOG, "events"),
    "ner_raw": (NER_RAW, "events"),
    "transformer_raw": (TRANSFORMER_RAW, "events"),
    "analyzer_raw": (ANALYZER_RAW, "events"),
    "mixed_ner_raw": (MIXED_NER_RAW, "events"),
    "li": (LI, "lineitem"),
    "easyocr_flat": (EASYOCR, "li"),
    "tesseract_raw": (TESSERACT, "li"),
    "detections_raw": (DETECTIONS, "li"),
    "runs": (RUNS, "events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from it."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, source = TABLES[name]
    # The source name stands alone after "from" in every derived table.
    sql = sql.replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def with_tables(*names: str) -> str:
    """WITH list of derived tables and what they derive from, for the checking database."""
    ordered: list[str] = []
    for name in names:
        source = TABLES[name][1] if name in TABLES else None
        for n in (source, name):
            if n in TABLES and n not in ordered:
                ordered.append(n)
    return "with recursive " + ",\n".join(f"{n} as ({TABLES[n][0]})" for n in ordered)
