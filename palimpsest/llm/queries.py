"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, line_chunks, mixing, packing, periodic, quality, secret_scan, simhash, spelling, style_tree, suffix, toxicity
from palimpsest.llm.shared import WORD, table, written

#: Target weights of the mixing query and of the pipeline: sources below src10 are the domain "open", the rest "curated".
MIX_WEIGHTS = (
    ("open", None, None, 2), ("curated", None, None, 3),
    ("open", "en", None, 4), ("open", "de", None, 2), ("curated", "en", None, 3), ("curated", "fr", None, 2),
    ("curated", "en", "src12", 5), ("open", "en", "src0", 3),
)
MIX_SEED = 17


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIX_WEIGHTS), "domain string, lang string, source string, weight long")


def domain(source: str = "source") -> Column:
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as int)")
    return F.when(number < 10, F.lit("open")).otherwise(F.lit("curated"))


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return style_tree.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs.select("doc_id", toxicity.held_out().alias("held_out"), F.col("text").alias("_whole")), model, "_whole").drop("_whole")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_chunks.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "n_removed_chunks", "n_removed_lines", F.length(kept).cast("long").alias("n_kept_chars"), F.md5(kept).alias("kept_md5"))


def op3_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_chunks.without_passages(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "n_removed_lines", F.length(kept).cast("long").alias("n_kept_chars"), F.md5(kept).alias("kept_md5"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "n_windows", "first_word")


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Cut inside a code point, ``text`` has a replacement character there; the digest is of the bytes."""
    return suffix.deduplicated(table(spark, folder, "documents")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.verdicts(quality.apply_policy(quality.ledger(table(spark, folder, "documents")), "v2"))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_rules"),
        "kept_base", "kept_v1", "kept_v2", "only_rule",
    )


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", fingerprint, F.col("first.doc_id").alias("component_id"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatted(table(spark, folder, "conversations"))


def op9_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", domain().alias("domain"), "lang", "source", mixing.token_count().alias("n_tokens"))
    return mixing.mix(written(docs, "sizes"), mix_weights(spark), budget_share=1.0, max_epochs=3, seed=MIX_SEED)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` where the contract's tenth of the documents goes on from word a in periods of p words."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1)))
    split = hashed.withColumn("w", chosen).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(pmod(g, n) as int)")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + pmod(g, 8)) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)")
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_period(table(spark, folder, "documents")))
    # exact below 2**26 words: unequal quotients of so small numbers differ as doubles too
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, folder, "documents"))
    names = F.array(*(F.lit(k) for k in secret_scan.KINDS))
    base = F.filter("spans", lambda s: s["probability"].isNull())
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(3).alias("n_network")
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    hashed = F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "run").cast("binary"))
    at = F.pmod(hashed, F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = spelling.variants(table(spark, folder, "documents"), respelled=F.when(hashed % 199 == 0, shorter).otherwise(F.col("run")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def _mixing_sql() -> str:
    """Leaves and their quotas as ``final``: each level's quota shared by weight, full children first."""
    given = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in row) + ")" for row in MIX_WEIGHTS)
    keys = ("domain", "la", "so")
    levels = []
    for k in (1, 2, 3):
        own, over = ", ".join(keys[:k]), f"partition by {', '.join(keys[: k - 1])}" if k > 1 else ""
        order = f"{over} order by cap::double / weight, {keys[k - 1]}"
        levels.append(f"""
child{k} as (select {own}, max(u{k}) as cap, max(w{k}) as weight, max(q{k - 1}) as parent from level{k - 1} group by {own}
), line{k} as (
  select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
    sum(weight) over ({order} rows between current row and unbounded following)::bigint as weights from child{k} where cap > 0 and weight > 0
), full{k} as (
  select *, min(case when cap * weights <= (parent - caps) * weight then 1 else 0 end)
    over ({order} rows between unbounded preceding and current row) as full_up from line{k}
), share{k} as (
  select {own}, case when full_up = 1 then cap else ((parent - min(caps) filter (full_up = 0) over ({over})) * weight)
    // (max(weights) filter (full_up = 0) over ({over})) end as q{k} from full{k}
), level{k} as (select level{k - 1}.*, coalesce(q{k}, 0)::bigint as q{k} from level{k - 1} left join share{k} using ({own}))""")
    return f"""given(domain, lang, source, weight) as (values {given}
), sized as (
  select doc_id, case when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) < 10 then 'open' else 'curated' end as domain, lang, source,
    coalesce(lang, '') as la, coalesce(source, '') as so, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents
), leaves as (select domain, la, so, sum(n_tokens)::bigint as tokens from sized group by all
), weighed as (
  select l.*, 3 * tokens as cap3, coalesce(a.weight, 1) as w1, coalesce(b.weight, 1) as w2, coalesce(c.weight, 1) as w3 from leaves l
  left join (select * from given where lang is null and source is null) a on a.domain = l.domain
  left join (select * from given where lang is not null and source is null) b on b.domain = l.domain and b.lang = l.la
  left join (select * from given where source is not null) c on c.domain = l.domain and c.lang = l.la and c.source = l.so
), u3 as (select *, case when w3 > 0 then cap3 else 0 end as u3 from weighed
), u2 as (select *, case when w2 > 0 then sum(u3) over (partition by domain, la) else 0 end::bigint as u2 from u3
), firsts as (select *, case when row_number() over (partition by domain, la order by so) = 1 then u2 else 0 end as once from u2
), level0 as (
  select *, case when w1 > 0 then sum(once) over (partition by domain) else 0 end::bigint as u1, (sum(tokens) over ())::bigint as q0 from firsts
),{",".join(levels)}, final as (select domain, la, so, tokens, q3 as quota from level3)"""


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_line_dedup, op3_passage_dedup, op4_decontamination, op5_suffix_array_dedup, op6_quality_rules, op7_simhash_near_dedup, op8_chat_formatting, op9_token_packing, op10_source_mixing, op11_periodic_runs, op12_secret_scan, op13_spelling_variants, pipeline)}
ORACLES: dict[str, str] = {
    # lines, rolling hash of two line hashes, chunks, and all but the first of equal chunks cut
    "op3_line_dedup": """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents
), hashed as (select *, ('0x' || substr(md5(line), 1, 7))::bigint as h from lines
), rolled as (
  select *, case when (h + coalesce(lag(h) over (partition by doc_id order by i), 0) * 131) % 2147483647 % 3 = 0 then 1 else 0 end as ends from hashed
), numbered as (
  select *, coalesce(sum(ends) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from rolled
), chunks as (select doc_id, chunk, count(*) as n, string_agg(line, chr(10) order by i) as body from numbered group by all
), ranked as (
  select *, case when n >= 2 then row_number() over (partition by body, n >= 2 order by doc_id, chunk) else 1 end as place from chunks
), kept as (
  select doc_id, count(*) filter (place > 1) as n_removed_chunks, coalesce(sum(n) filter (place > 1), 0)::bigint as n_removed_lines,
    coalesce(string_agg(body, chr(10) order by chunk) filter (place = 1), '') as body from ranked group by doc_id
)
select doc_id, n_removed_chunks, n_removed_lines, length(body)::bigint as n_kept_chars, md5(body) as kept_md5 from kept""",
    # every two neighbouring lines that aren't blank; all but the first place of a pair cut, with the blank lines between
    "op3_passage_dedup": """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents
), pairs as (
  select doc_id, i, line, lead(line) over p as after, lead(i) over p as until from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') window p as (partition by doc_id order by i)
), ranked as (select *, row_number() over (partition by line, after order by doc_id, i) as place from pairs where after is not null
), gone as (select distinct doc_id, unnest(range(i, until + 1)) as i, true as cut from ranked where place > 1
), kept as (
  select doc_id, count(cut)::bigint as n_removed_lines, coalesce(string_agg(line, chr(10) order by i) filter (cut is null), '') as body
  from lines left join gone using (doc_id, i) group by doc_id
)
select doc_id, n_removed_lines, length(body)::bigint as n_kept_chars, md5(body) as kept_md5 from kept""",
    "op6_quality_rules": """
with words as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
), windows as (
  select doc_id, i, lead(word, 1) over p as w2, lead(word, 2) over p as w3, word from each window p as (partition by doc_id order by i)
), counted as (
  select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as times from windows where w3 is not null
), repeated as (
  select doc_id, count(distinct i + k) as n_repeat_words from counted, (select unnest([0, 1, 2]) as k) where times > 1 group by doc_id
), lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
), lined as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
), kinds as (select doc_id, word, count(*) as n from each group by all
), worded as (
  select doc_id, count(*) as n_kinds, max(n) as top, coalesce(sum(n) filter (upper(word) = word and lower(word) <> word and len(word) > 1), 0) as n_capital,
    coalesce(sum(n) filter (regexp_matches(word, '[!?][!?]$')), 0) as n_marked from kinds group by doc_id
), m as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_kinds, 0) as n_kinds, coalesce(top, 0) as top,
    coalesce(n_capital, 0) as n_capital, coalesce(n_marked, 0) as n_marked
  from words left join repeated using (doc_id) left join lined using (doc_id) left join worded using (doc_id)
), bits as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 2 * n_symbols > n_words then 4 else 0 end + case when n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end
    + case when 2 * n_capital > n_words then 64 else 0 end + case when 2 * n_marked > n_words then 128 else 0 end
    + case when 100 * top > 40 * n_words then 256 else 0 end
    + case when n_words >= 50 and n_kinds * n_kinds < 2 * n_words then 512 else 0 end)::bigint as failed_rules from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 as base_failed, failed_rules = 0 as kept, failed_rules,
 failed_rules & 3 = 0 as kept_base, failed_rules & 63 = 0 as kept_v1, failed_rules = 0 as kept_v2,
 case when bit_count(failed_rules) = 1 then log2(failed_rules)::INT end as only_rule from bits""",
    # all windows that start with a shingle of an item, compared by counts of shingles (every item has five words or more)
    "op4_decontamination": """
with split as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingled as (
  select doc_id, unnest(range(0, len(w) - 4)) as pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s,
    len(w) - 4 as n from split where len(w) >= 5
), items as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w from benchmark
), needles as (
  select item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s, len(w) - 4 as m from items where len(w) >= 5
), counted as (select item_id, s, m, count(*) as times from needles group by all
), hits as (select doc_id, pos, s, n, item_id, m, times from shingled join counted using (s)
), inside as (
  select a.doc_id, a.item_id, a.pos, any_value(a.n) as n, any_value(a.m) as m, b.s, least(count(*), any_value(b.times)) as common
  from hits a join hits b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.pos between a.pos and a.pos + a.m - 1 group by a.doc_id, a.item_id, a.pos, b.s
), compared as (
  select doc_id, item_id, pos, sum(common)::double / (any_value(m) + least(any_value(m), any_value(n) - pos) - sum(common)) as similarity from inside group by doc_id, item_id, pos
)
select doc_id, item_id, round(max(similarity), 6) as similarity, count(*) as n_windows, arg_min(pos, (-similarity, pos))::int as first_word
from compared where similarity >= 0.8 group by doc_id, item_id""",
    "op10_source_mixing": f"""
with {_mixing_sql()}
select doc_id, domain, d.lang, d.source, n_tokens, epochs + more as copies
from (
  select *, case when rest > 0 and coalesce(sum(n_tokens) over (partition by domain, la, so order by key, doc_id, n_tokens
    rows between unbounded preceding and 1 preceding), 0) < rest then 1 else 0 end as more
  from (select *, md5('{MIX_SEED}:' || epochs || ':' || doc_id) as key from (
    select sized.*, quota // tokens as epochs, quota % tokens as rest from sized join final using (domain, la, so) where quota > 0 and tokens > 0))
) d where epochs + more > 0""",
    # counts with the checksum worked out bit by bit, words that agree once a letter is left out, and forms followed to the last
    "op13_spelling_variants": """
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
), pairs as (
  select run, count(*) as times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) as digits from runs where length(run) >= 6 group by doc_id, run
), hashed as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end))) as h from pairs
), respelled as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed
), words as (
  select word, sum(times)::BIGINT as n from respelled where length(word) >= 6 group by word having sum(times) >= 5
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cut c join words w on c.rest = w.word
), best as (
  select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as most from near group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 5 * w.n then other end as form, case when most >= 5 * w.n then most end as form_n from words w left join best using (word)
), follow as (
  select word, coalesce(form, word) as root, form is not null as more from formed
  union all select f.word, g.form, true from follow f join formed g on f.root = g.word where f.more and g.form is not null
), ends as (select word, root from follow where root in (select word from formed where form is null))
select f.word, form, root, n, n_near, form_n from formed f join ends using (word)""",
}
