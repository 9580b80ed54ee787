"""Columns of the caller's whose names are also those of helpers: nothing is lost, mixed up or dropped."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, line_chunks, mixing, packing, simhash, style_tree, suffix, toxicity

HELPERS = ["__id", "__hash", "__host", "__text", "__tokens", "__low", "__gone", "__key", "__domain", "__of", "__size", "__score", "__copies", "_first", "__ID2"]
SAME = "the same passage of words stands in both of these texts\nand it has a second line"


def docs_of(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{SAME} {item}", "en", "src1", 9), (2, "another text of its own", "de", "src2", 9), (3, f"{SAME} {item}", "en", "src1", 9), (4, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in HELPERS)), spark.createDataFrame([(7, item)], "item_id long, text string")


def kept(frame):
    """Ids, after a look at whether every other column still belongs to its row."""
    assert set(HELPERS) <= set(frame.columns)
    rows = frame.collect()
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in HELPERS)
    return sorted(r.doc_id for r in rows)


def test_operators(spark):
    docs, items = docs_of(spark)
    assert kept(simhash.deduplicated(docs)) == [1, 2, 4]
    assert kept(decontaminate.clean(docs, items)) == [2, 4]
    assert kept(line_chunks.deduplicated(docs)) == kept(line_chunks.without_passages(docs)) == [1, 2, 3, 4]
    assert kept(toxicity.scored(docs, toxicity.Model(share=0.5))) == [1, 2, 3, 4]
    sized = docs.withColumn("domain", F.lit("a")).withColumn("n", F.lit(5))
    weights = spark.createDataFrame([("a", None, None, 1)], "domain string, lang string, source string, weight long")
    assert kept(mixing.mix(sized, weights, tokens="n")) == [1, 2, 3, 4]
    assert kept(mixing.mix(sized.withColumnRenamed("n", "__n").withColumn("n", F.lit(0)), weights, tokens="__n").drop("__n")) == [1, 2, 3, 4]
    pages = docs.withColumn("html", F.lit("<p>x</p>")).withColumn("url", F.lit("http://a.org"))
    assert kept(style_tree.main_text(pages)) == [1, 2, 3, 4]
    assert suffix.deduplicated(docs, length=40, gram=16).where("n_removed > 0").count() == 2
    assert packing.unpack(packing.pack(docs)).count() == 4


@pytest.mark.parametrize("name, left", [("simhash_near_dedup", [1, 2, 4]), ("benchmark_decontamination", [2, 4])])
def test_stages(spark, tmp_path, name, left):
    docs, items = docs_of(spark)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert kept(out) == left and out.columns == docs.columns


def test_first_and_mixing_stage(spark, tmp_path):
    docs, _ = docs_of(spark)
    spark.createDataFrame([(k, 0) for k in range(1, 5)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert set(kept(dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)))) >= {2, 3, 4}
    assert set(kept(dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, str(tmp_path)))) >= {1, 2}
