"""SQL building blocks of the checks: written apart from the operators, in relational form."""

from __future__ import annotations

from palimpsest.functions import constants as C

ROOM_LOOKAHEAD = r"\b\d{3}[A-Z]?(?=\s*(room|office|door))\b"
# The checking database has no lookahead, so the place word is matched and group 1 is taken.
ROOM_GROUP = r"\b(\d{3}[A-Z]?)\s+(?:room|office|door)"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def security_rules() -> list[tuple]:
    """(engine_no, rule_no, label, engine, pattern, score) of the identifier patterns."""
    rows, number = [], 0
    for label, patterns in C.SECURITY_PATTERNS.items():
        for pattern in patterns:
            rows.append((3, number, label, "custom_patterns", pattern, None))
            number += 1
    return rows


def ip_rules() -> list[tuple]:
    return [(3, 0, "IP_ADDRESS", "custom_patterns", C.SECURITY_PATTERNS["IP_ADDRESS"][0], None)]


def standard_rules(first: int = 100) -> list[tuple]:
    return [
        (0, first + i, label, "presidio", pattern, score)
        for i, (label, (pattern, score)) in enumerate(C.STANDARD_PATTERNS.items())
    ]


def security_id_rules(first: int = 105) -> list[tuple]:
    return [
        (0, first + i, "SECURITY_ID", "presidio", pattern, C.SECURITY_ID_SCORE)
        for i, pattern in enumerate(C.SECURITY_ID_PATTERNS)
    ]


def all_rules() -> list[tuple]:
    return standard_rules() + security_id_rules() + security_rules()


LUHN = """(list_sum(list_transform(range(0, length(digits)), lambda k:
 case when k % 2 = 0 then substr(reverse(digits), k + 1, 1)::INT
  when 2 * substr(reverse(digits), k + 1, 1)::INT > 9
   then 2 * substr(reverse(digits), k + 1, 1)::INT - 9
  else 2 * substr(reverse(digits), k + 1, 1)::INT end)) % 10 = 0)"""


def found_sql(source: str, rules: list[tuple]) -> str:
    """All findings of `rules` in `source` (doc_id, text), one row each."""
    branches = []
    for engine_no, rule_no, label, engine, pattern, score in rules:
        group, regex = (1, ROOM_GROUP) if pattern == ROOM_LOOKAHEAD else (0, pattern)
        regex = lit("(?i)" + regex)
        branches.append(
            f"select doc_id, {engine_no} as engine_no, {rule_no} as rule_no, {lit(label)} as label, "
            f"{lit(engine)} as engine, {'null' if score is None else score}::DOUBLE as score, "
            f"regexp_extract_all(text, {regex}) as m, "
            f"regexp_extract_all(text, {regex}, {group}) as shown, "
            f"string_split_regex(text, {regex}) as g "
            f"from {source} where regexp_matches(text, {regex})"
        )
    hits = "\nunion all ".join(branches)
    return f"""select doc_id, engine_no, rule_no, label, engine, start, start + length(t)::INT as "end",
 t as text, coalesce(score, least(0.8::DOUBLE
  + case when length(t) > 8 then 0.1::DOUBLE else 0::DOUBLE end
  + case when regexp_matches(t, '[-_]') then 0.05::DOUBLE else 0::DOUBLE end, 1::DOUBLE)) as confidence,
 true as is_sensitive
from (select *, regexp_replace(t, '[^0-9]', '', 'g') as digits from (
 select *, shown[i] as t,
  (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT as start
 from (select *, unnest(range(1, len(m) + 1)) as i from ({hits}))))
where label <> 'CREDIT_CARD' or {LUHN}"""


def raw_sql(ner: str | None, transformer: str | None, analyzer: str | None, docs: str) -> str:
    """Findings of the external tables."""
    parts = []
    valid = 'r.start >= 0 and r.start < r.end_pos and r.end_pos <= length(d.text)'
    if analyzer:
        parts.append(
            f"""select doc_id, 0 as engine_no, 0 as rule_no, entity_type as label,
 'presidio' as engine, start, end_pos as "end", substring(text, start + 1, end_pos - start) as text,
 score as confidence, true as is_sensitive
from {analyzer} r join {docs} d using (doc_id) where {valid} and score is not null"""
        )
    if ner:
        labels = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in C.NER_LABELS.items())
        parts.append(
            f"""select * from (select doc_id, 1 as engine_no, 0 as rule_no,
 case raw_label {labels} end as label, 'spacy' as engine, start, end_pos as "end", t as text,
 least(greatest(0.8::DOUBLE + case when length(t) > 10 then 0.1::DOUBLE else 0::DOUBLE end
  + case when regexp_matches(t, '[A-Za-z]') and t = array_to_string(list_transform(
    string_split(t, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')
    then 0.05::DOUBLE else 0::DOUBLE end
  - case when length(t) <= 2 then 0.2::DOUBLE else 0::DOUBLE end, 0::DOUBLE), 1::DOUBLE) as confidence,
 raw_label in ('PERSON', 'ORG', 'GPE', 'MONEY') as is_sensitive
from (select r.*, substring(d.text, r.start + 1, r.end_pos - r.start) as t
 from {ner} r join {docs} d using (doc_id) where {valid}))
where label is not null and confidence >= 0.7::DOUBLE"""
        )
    if transformer:
        labels = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in C.TRANSFORMER_LABELS.items())
        parts.append(
            f"""select doc_id, 2 as engine_no, 0 as rule_no,
 case upper(entity_group) {labels} else entity_group end as label, 'transformer' as engine,
 start, end_pos as "end", substring(text, start + 1, end_pos - start) as text, score as confidence,
 upper(entity_group) in ('PER', 'PERSON', 'ORG', 'ORGANIZATION') as is_sensitive
from {transformer} r join {docs} d using (doc_id) where {valid} and score >= 0.8::DOUBLE"""
        )
    return "\nunion all ".join(parts)


def scored_sql(found: str, docs: str) -> str:
    """Findings with context score and raised confidence."""

    def count(category: str) -> str:
        return " + ".join(f"contains(near, {lit(w)})::INT" for w in C.CONTEXT_KEYWORDS[category])

    return f"""select * exclude (near, hits, raw_confidence),
 least(raw_confidence + context_score, 1::DOUBLE) as confidence from (
 select *, [0::DOUBLE, 0.05::DOUBLE, 0.05::DOUBLE + 0.05::DOUBLE,
   0.05::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE][hits + 1]
   as context_score
 from (select *, case
   when label in ('PERSON', 'EMAIL_ADDRESS', 'PHONE_NUMBER') then {count('personal')}
   when label in ('CREDIT_CARD', 'SSN') then {count('financial')}
   when label like '%EMPLOYEE%' then {count('corporate')}
   when label in ('IP_ADDRESS', 'MAC_ADDRESS') then {count('technical')} else 0 end as hits
 from (select f.* exclude (confidence), f.confidence as raw_confidence,
   lower(substring(d.text, greatest(f.start - 100, 0) + 1,
    least(f."end" + 100, length(d.text)) - greatest(f.start - 100, 0))) as near
  from {found} f join {docs} d using (doc_id))))"""


def merge_ctes(scored: str) -> str:
    """CTEs `ordered`, `walk` and `merged`: step by step over the findings of a document."""
    return f"""ordered as (select *, row_number() over (partition by doc_id
 order by start, engine_no, rule_no, "end", label) as rn from {scored}),
walk as (
 select doc_id, rn, rn as win, "end" as win_end, "end" - start as win_size,
  confidence as win_conf, 1 as grp from ordered where rn = 1
 union all
 select o.doc_id, o.rn,
  case when o.start >= k.win_end or o.confidence > k.win_conf or (o.confidence = k.win_conf
    and o."end" - o.start > k.win_size) then o.rn else k.win end,
  case when o.start >= k.win_end or o.confidence > k.win_conf or (o.confidence = k.win_conf
    and o."end" - o.start > k.win_size) then o."end" else k.win_end end,
  case when o.start >= k.win_end or o.confidence > k.win_conf or (o.confidence = k.win_conf
    and o."end" - o.start > k.win_size) then o."end" - o.start else k.win_size end,
  case when o.start >= k.win_end or o.confidence > k.win_conf or (o.confidence = k.win_conf
    and o."end" - o.start > k.win_size) then o.confidence else k.win_conf end,
  k.grp + case when o.start >= k.win_end then 1 else 0 end
 from walk k join ordered o on o.doc_id = k.doc_id and o.rn = k.rn + 1),
merged as (select o.* from (select doc_id, grp, arg_max(win, rn) as win from walk group by all) w
 join ordered o on o.doc_id = w.doc_id and o.rn = w.win)"""


def detection(
    tables: str,
    docs: str,
    rules: list[tuple],
    threshold: float,
    ner: str | None = None,
    transformer: str | None = None,
    analyzer: str | None = None,
    prefix: bool = True,
) -> str:
    """CTE list ending in found, scored, merged and entities."""
    found = found_sql(docs, rules)
    raw = raw_sql(ner, transformer, analyzer, docs)
    if raw:
        found = f"{found}\nunion all by name {raw}"
    head = (tables + ",\n") if tables else "with recursive "
    return f"""{head}found as ({found}),
scored as ({scored_sql('found', docs)}),
{merge_ctes('scored')},
entities as (select * from merged where confidence >= {threshold}::DOUBLE)"""


ENTITY_COLUMNS = (
    'doc_id, row_number() over (partition by doc_id order by {order})::INT - 1 as seq, text, label, '
    'start, "end"::INT as "end", confidence, engine, context_score, is_sensitive'
)


def by_position(source: str, context: str = "context_score") -> str:
    columns = ENTITY_COLUMNS.format(order="start").replace("context_score", context)
    return f"select {columns} from {source}"


def by_arrival(source: str) -> str:
    columns = ENTITY_COLUMNS.format(order="engine_no, rule_no, start").replace(
        "context_score", "0::DOUBLE as context_score"
    )
    return f"select {columns} from {source}"


def draw(text: str, place: str, n: int) -> str:
    return f"(('0x' || substr(sha256('palimpsest:' || {text} || ':' || {place}), 1, 8))::BIGINT % {n})"


def choose(values: tuple[str, ...], draw_sql: str) -> str:
    return f"[{', '.join(lit(v) for v in values)}][{draw_sql} + 1]"


def strategy_sql(name: str, text: str = "text", label: str = "label") -> str:
    """Replacement under one strategy."""
    bracket = f"'[' || {label} || ']'"
    n = f"length({text})"
    at = f"strpos({text}, '@')"
    char = f"substr({text}, k + 1, 1)"
    sqls = {
        "mask": f"case when {n} <= 2 then repeat('*', {n}) else "
        f"left({text}, 1) || repeat('*', {n} - 2) || right({text}, 1) end",
        "replace": bracket,
        "replace_realistic": f"case {label} when 'PERSON' then "
        f"{choose(C.FIRST_NAMES, draw(text, lit('first'), 8))} || ' ' || "
        f"{choose(C.LAST_NAMES, draw(text, lit('last'), 8))} when 'ORGANIZATION' then "
        f"{choose(C.COMPANIES, draw(text, lit('company'), 4))} else {bracket} end",
        "replace_format": f"array_to_string(list_transform(range(0, {n}), lambda k: case "
        rf"when regexp_matches({char}, '\d') then {draw(text, 'k', 10)}::VARCHAR "
        rf"when regexp_matches({char}, '\p{{Lu}}') then chr((65 + {draw(text, 'k', 26)})::INT) "
        rf"when regexp_matches({char}, '\p{{L}}') then chr((97 + {draw(text, 'k', 26)})::INT) "
        f"else {char} end), '')",
        "replace_partial": f"case when {n} <= 4 then repeat('*', {n}) else "
        f"left({text}, 2) || repeat('*', {n} - 4) || right({text}, 2) end",
        "replace_domain": f"case when {at} = 0 then {text} else regexp_replace(regexp_replace("
        f"left({text}, {at} - 1), '[a-zA-Z]', 'x', 'g'), '[0-9]', '0', 'g') || '@' || "
        f"{choose(C.DOMAINS, draw(text, lit('domain'), 4))} end",
        "replace_network": f"'192.168.' || {draw(text, lit('third'), 255)} || '.' || "
        f"{draw(text, lit('fourth'), 255)}",
        "hash": f"substr(sha256({text}), 1, 16)",
        "encrypt": f"'ENC_' || array_to_string(list_transform(range(0, {n}), lambda k: "
        f"printf('%02x', unicode({char}))), '')",
    }
    return f"({sqls.get(name, bracket)})"


def auto_sql(table: dict[str, str] | None = None) -> str:
    cases = " ".join(
        f"when {lit(k)} then {strategy_sql(v)}" for k, v in (table or C.DEFAULT_STRATEGIES).items()
    )
    return f"case label {cases} else {strategy_sql('replace')} end"


def rewritten_ctes(docs: str, value: str, entities: str = "entities") -> str:
    """CTEs `replaced` (one row per entity) and `rewritten` (one row per document)."""
    return f"""replaced as (select *, {value} as anonymized,
 lag("end", 1, 0) over (partition by doc_id order by start) as done from {entities}),
pieces as (select r.doc_id, string_agg(substring(d.text, r.done + 1, r.start - r.done) || r.anonymized,
  '' order by r.start) as front, max(r."end") as last_end, count(*)::INT as n
 from replaced r join {docs} d using (doc_id) group by r.doc_id),
rewritten as (select d.doc_id, case when p.n is null then d.text
  else p.front || substring(d.text, p.last_end + 1) end as anonymized_text,
  coalesce(p.n, 0)::INT as entities_processed
 from {docs} d left join pieces p using (doc_id))"""
