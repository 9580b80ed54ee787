"""Registered queries: logo boxes and regions to cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.checks.ocr import page_ids
from palimpsest.checks.sql import lit
from palimpsest.checks.tables import table, with_tables
from palimpsest.functions import constants as C
from palimpsest.operators.boxes import (
    classified,
    display_boxes,
    logo_classes,
    logo_counts,
    ranked,
    region_plan,
    removable,
    removal_plan,
    suppress,
    sure_boxes,
    top_boxes,
)

Query = Callable[[SparkSession, str], DataFrame]
BOX = ["doc_id", "seq", "class_id", "confidence", "x1", "y1", "x2", "y2"]


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "detections_raw")


def logos(spark: SparkSession, sf: str) -> DataFrame:
    return classified(sure_boxes(raw(spark, sf)), logo_classes(spark))


def sized(boxes: DataFrame) -> DataFrame:
    """Boxes with the size of their image."""
    return boxes.withColumn("width", (F.col("doc_id") % 50 + 40).cast("int")).withColumn(
        "height", (F.col("doc_id") % 40 + 30).cast("int")
    )


def plan(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.expr(
        "element_at(array('inpaint', 'blur', 'pixelate', 'black_box', 'replace', 'shred'), "
        "cast(doc_id % 6 as int) + 1)"
    )
    return removal_plan(sized(removable(logos(spark, sf))), wanted).drop("width", "height", "sensitive")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.expr(
        "element_at(array('blur', 'pixelate', 'black_box', 'white_box', 'shred'), "
        "cast(doc_id % 5 as int) + 1)"
    )
    tokens = table(spark, sf, "easyocr_flat").select("doc_id", "seq", "x1", "y1", "x2", "y2")
    return region_plan(sized(tokens), wanted).drop("width", "height")


def counts(spark: SparkSession, sf: str) -> DataFrame:
    out = logo_counts(page_ids(spark, sf), logos(spark, sf))
    return out.withColumn("logo_confidence", F.round("logo_confidence", 6))


QUERIES: dict[str, Query] = {
    "logos_classified": logos,
    "logos_ranked": lambda s, d: ranked(raw(s, d)).select(*BOX, "rank"),
    "logos_top": lambda s, d: top_boxes(raw(s, d), k=3).select(*BOX, "rank"),
    "logos_suppressed": lambda s, d: suppress(raw(s, d)).select(*BOX),
    "logos_suppressed_across_classes": lambda s, d: suppress(raw(s, d), by_class=False).select(*BOX),
    "logo_removal_plan": plan,
    "text_region_plan": regions,
    "logo_counts": counts,
    "logos_displayed": lambda s, d: display_boxes(logos(s, d)),
}

_HEAD = with_tables("detections_raw")
_CLASSES = ", ".join(
    f"({i}, {lit(n)}, {lit(c)}, {str(s).lower()})" for i, n, c, s in C.LOGO_CLASSES
)
LOGO_CTES = f"""classes as (select * from (values {_CLASSES}) v(class_id, name, category, known)),
logos as (select d.*, coalesce(name, 'unknown_' || d.class_id) as class_name,
  coalesce(known, false) as sensitive, (x2::BIGINT - x1) * (y2 - y1) as area
 from detections_raw d left join classes using (class_id) where confidence >= 0.6::DOUBLE)"""


def suppressed_sql(keys: str) -> str:
    inter = (
        "greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0)::DOUBLE"
        " * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0)"
    )
    union = f"(greatest(k.x2 - k.x1, 0) * greatest(k.y2 - k.y1, 0) + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - {inter})"
    on = " and ".join(f"o.{k} = w.{k}" for k in keys.split(", "))
    selected = ", ".join(f"o.{k}" for k in keys.split(", "))
    return f"""{_HEAD}, numbered as (select *, row_number() over (partition by {keys}
  order by confidence desc, seq) as rn,
  {{'seq': seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} as b from detections_raw),
w as (select {keys}, rn, [b] as kept from numbered where rn = 1
 union all
 select {selected}, o.rn, case when len(list_filter(w.kept, lambda k:
   {inter.replace('b.', 'o.b.')} > 0.5::DOUBLE * {union.replace('b.', 'o.b.')})) > 0
  then w.kept else list_append(w.kept, o.b) end
 from w join numbered o on {on} and o.rn = w.rn + 1),
final as (select {keys}, unnest(arg_max(kept, rn)) as k from w group by {keys})
select n.doc_id, n.seq, n.class_id, n.confidence, n.x1, n.y1, n.x2, n.y2
from numbered n join (select *, k.seq as seq from final) f using ({keys}, seq)"""


def padded(pad: str) -> str:
    return (
        f"greatest(0, x1 - {pad})::INT as x1, greatest(0, y1 - {pad})::INT as y1, "
        f"least(width, x2 + {pad})::INT as x2, least(height, y2 + {pad})::INT as y2"
    )


SIZES = "(doc_id % 50 + 40)::INT as width, (doc_id % 40 + 30)::INT as height"

ORACLES: dict[str, str] = {
    "logos_classified": f"""{_HEAD}, {LOGO_CTES} select doc_id, seq, class_id, confidence, x1, y1, x2, y2,
 class_name, sensitive, area from logos""",
    "logos_ranked": f"""{_HEAD} select *, row_number() over (partition by doc_id
 order by confidence desc, seq)::INT as rank from detections_raw""",
    "logos_top": f"""{_HEAD} select * from (select *, row_number() over (partition by doc_id
 order by confidence desc, seq)::INT as rank from detections_raw) where rank <= 3""",
    "logos_suppressed": suppressed_sql("doc_id, class_id"),
    "logos_suppressed_across_classes": suppressed_sql("doc_id"),
    "logo_removal_plan": f"""{_HEAD}, {LOGO_CTES} select doc_id, seq, class_id, confidence, {padded('pad')},
 class_name, area, method from (select *, {SIZES},
  ['inpaint', 'blur', 'pixelate', 'black_box', 'replace', 'black_box'][doc_id % 6 + 1] as method,
  case doc_id % 6 when 0 then 5 when 4 then 20 else 0 end as pad
 from logos where confidence >= 0.7::DOUBLE and sensitive)""",
    "text_region_plan": f"""{with_tables('easyocr_flat')} select * from (
 select doc_id, seq, {padded('0')},
 ['blur', 'pixelate', 'black_box', 'white_box', 'blur'][doc_id % 5 + 1] as method
 from (select *, {SIZES} from easyocr_flat)) where x2 > x1 and y2 > y1""",
    "logo_counts": f"""{_HEAD}, {LOGO_CTES} select i.doc_id, count(l.seq) as logos_found,
 count(*) filter (l.confidence >= 0.7::DOUBLE and l.sensitive) as removed_logos,
 round(coalesce(avg(l.confidence), 0), 6) as logo_confidence
from (select distinct l_orderkey as doc_id from li) i left join logos l using (doc_id) group by i.doc_id""",
    "logos_displayed": f"""{_HEAD}, {LOGO_CTES} select doc_id, seq, class_name as logo_type,
 round_even(confidence * 100, 0)::INT || '%' as confidence, area || ' px²' as area,
 '(' || x1 || ', ' || y1 || ') to (' || x2 || ', ' || y2 || ')' as position from logos""",
}
