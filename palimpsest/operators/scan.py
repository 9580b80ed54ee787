"""Pattern scan: every match of every recogniser, with offsets, as an array on the document row.

Nothing is shuffled: the findings of a text stay beside it. Offsets count code points from 0
and ends are exclusive.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import empty_array, fold_to_array, let_array, quoted, text_literal
from palimpsest.functions.recognisers import MARK_DIGITS, Recogniser
from palimpsest.functions.text import matches, passes_luhn

SPAN = "struct<start:int,end:int,text:string>"

# Field order is sort order: start, then arrival (engine, recogniser), then the rest.
FINDING = (
    "struct<start:int,engine_no:int,rule_no:int,end:int,label:string,text:string,"
    "confidence:double,engine:string,context_score:double,is_sensitive:boolean>"
)
FIELDS = (
    "start", "engine_no", "rule_no", "end", "label", "text", "confidence", "engine",
    "context_score", "is_sensitive",
)


def finding(old: str | None = None, **fields: str) -> str:
    """A finding from its fields; with `old`, a copy of it with some fields changed."""
    default = {"context_score": "0.0D", "is_sensitive": "true"}
    parts = []
    for name in FIELDS:
        value = fields.get(name) or (f"{old}.{name}" if old else default[name])
        parts.append(f"'{name}', {value}")
    return f"named_struct({', '.join(parts)})"


# Matches of one pattern that are looked up in the text one by one.
FEW_MATCHES = 4


def places(text: str, found: str) -> str:
    """Where few matches end, or null unless each of them stands in the text just once."""
    again = f"filter({found}, (m, i) -> locate(m, {text}, get(at, i) + 1) > 0)"
    ends = f"if(size({again}) = 0, transform({found}, (m, i) -> get(at, i) - 1 + length(m)), null)"
    return f"if(size({found}) <= {FEW_MATCHES}, {let_array(f'transform({found}, m -> locate(m, {text}))', 'at', ends, 'int')}, null)"


def match_ends(pieces: str) -> str:
    """Where the matches of one pattern end: running sums of the lengths of `pieces`, each a match and the gap before it."""
    step = "array_append(ends, coalesce(try_element_at(ends, -1), 0) + length(piece))"
    return fold_to_array(pieces, "int", "ends", "piece", step)


def pattern_confidence(text: str, base: float = C.PATTERN_BASE) -> str:
    """Base score, more for long values and for values with a separator, at most 1."""
    longer = f"if(length({text}) > {C.PATTERN_LONG_CHARS}, {C.PATTERN_LONG_BONUS}D, 0.0D)"
    parted = f"if(contains({text}, '-') or contains({text}, '_'), {C.PATTERN_SEPARATOR_BONUS}D, 0.0D)"
    return f"least({float(base)}D + {longer} + {parted}, 1.0D)"


def brief(text: str) -> str:
    """A text with `;` for its plain words, which patterns that hold or look at none are looked up in.

    Plain words are of ASCII letters, stand behind a blank or at the start, and before a blank or a comma and a blank. What is
    left keeps the blanks on both sides, and no pattern goes on from a blank into a letter or `;`. So such patterns have the same matches.
    """
    return f"regexp_replace({text}, {quoted(r'(?<!\S)(?:[A-Za-z]++,?+ ++)++')}, '; ')"


def marks(text: str) -> str:
    """What is left of a text without its plain words, in the form that pieces of patterns are looked up in.

    Letters are capitals as the patterns compare them (dotted and dotless i, long s and the kelvin sign are ASCII letters), digits are 0.
    Words that neither a digit nor `-` or `_` follows are left out with the blanks behind them.
    """
    odd = f"upper(translate({text}, 'ſıİ\u212a', 'SIIK'))"
    capitals = f"if(octet_length({text}) = length({text}), upper({text}), {odd})"
    rest = f"regexp_replace({capitals}, {quoted(r'[A-Z]++(?![-_\p{Nd}])[ ,]*+')}, '')"
    return f"regexp_replace({rest}, {quoted(rf'\p{{Nd}}{{1,{MARK_DIGITS}}}')}, '0')"


def _holds(pieces: list[str]) -> str:
    """Whether the marks of a text hold any of the pieces. A piece within another one stands for it too."""
    fewest = [p for p in dict.fromkeys(pieces) if not any(q != p and q in p for q in pieces)]
    return "(" + " or ".join(f"contains(marks, {text_literal(p)})" for p in fewest) + ")"


def _looked_up(text: str, rules: list[Recogniser]) -> str:
    """What the rules are looked up in."""
    return "brief" if all(rule.wordless for rule in rules) else text


def _hits(text: str, rule: Recogniser, rule_no: int, alone: bool) -> str:
    """Matches of one rule beside what is fixed of it, which Spark folds into one literal."""
    engine_no = C.ENGINES.index(rule.engine) if rule.engine in C.ENGINES else len(C.ENGINES)
    score = "cast(null as double)" if rule.score is None else f"{float(rule.score)}D"
    fixed = (
        f"named_struct('engine_no', {engine_no}, 'rule_no', {rule_no}, 'label', {text_literal(rule.label)}, "
        f"'engine', {text_literal(C.ENGINE_NAMES.get(rule.engine, rule.engine))}, 'score', {score}, 'luhn', {str(rule.luhn).lower()})"
    )
    hits = f"named_struct('rule', {fixed}, 'found', regexp_extract_all({_looked_up(text, [rule])}, {quoted(rule.regex)}, 0))"
    return f"if({_holds(list(rule.pieces))}, {hits}, null)" if rule.pieces and not alone else hits


def _group(text: str, gate: str | None, members: list[tuple[int, Recogniser]]) -> str:
    """Matches of the rules that share a gate. Where each of them has pieces, these are looked for before the gate."""
    hits = f"array({', '.join(_hits(text, rule, number, len(members) == 1) for number, rule in members)})"
    tests = [_holds([p for _, rule in members for p in rule.pieces])] if all(rule.pieces for _, rule in members) else []
    tests += [matches(_looked_up(text, [rule for _, rule in members]), gate)] if gate is not None else []
    return f"if({' and '.join(tests)}, {hits}, null)" if tests else hits


def _with_gaps(text: str, rules: list[tuple[int, Recogniser]]) -> str:
    """Each match of rule `hit.rule` with the text between it and the match before."""
    regexes = {number: quoted(rf"(?s)\G.*?(?-s:{rule.regex})") for number, rule in rules}
    cases = " ".join(f"when {number} then regexp_extract_all({text}, {regex}, 0)" for number, regex in regexes.items())
    return f"case hit.rule.rule_no {cases} end"


def scan_patterns(
    rules: list[Recogniser],
    text: str = "text",
    base: float = C.PATTERN_BASE,
    first_rule: int = 0,
    numbers: list[int] | None = None,
) -> str:
    """Array of findings of all `rules` in one text. Rules are numbered from `first_rule`, or as `numbers` has it."""
    if not rules:
        return empty_array(FINDING)
    numbers = numbers or list(range(first_rule, first_rule + len(rules)))
    numbered = sorted(zip(numbers, rules, strict=True), key=lambda r: r[1].gate or "")
    groups = [_group(text, gate, list(members)) for gate, members in groupby(numbered, key=lambda r: r[1].gate)]
    passed = f"filter(array({', '.join(groups)}), g -> g is not null)"
    hit_rules = f"filter(flatten({passed}), h -> size(h.found) > 0)"
    found = finding(
        start="get(ends, i) - length(m)",
        engine_no="hit.rule.engine_no",
        rule_no="hit.rule.rule_no",
        end="get(ends, i)",
        label="hit.rule.label",
        text="m",
        confidence=f"coalesce(hit.rule.score, {pattern_confidence('m', base)})",
        engine="hit.rule.engine",
    )
    each = f"transform(hit.found, (m, i) -> {found})"
    ends = f"coalesce({places(text, 'hit.found')}, {match_ends(_with_gaps(text, numbered))})"
    spans = let_array(ends, "ends", each, FINDING)
    valid = f"filter({spans}, f -> not hit.rule.luhn or {passes_luhn('f.text')})"
    scanned = f"flatten(transform({hit_rules}, hit -> {valid}))"
    return let_array(brief(text), "brief", let_array(marks("brief"), "marks", scanned, FINDING), FINDING)


def explode_findings(
    docs: DataFrame, column: str, key: str = "doc_id", arrival: bool = True
) -> DataFrame:
    """Long table of findings. `seq` numbers them per document, by arrival or by position."""
    items = column
    if arrival:
        by_arrival = "named_struct('e', f.engine_no, 'r', f.rule_no, 's', f.start, 'item', f)"
        items = f"transform(array_sort(transform({column}, f -> {by_arrival})), s -> s.item)"
    # The outer form keeps the scan from being repeated in a derived "not empty" filter.
    shown = ["text", "label", "start", "end", "confidence", "engine", "context_score", "is_sensitive"]
    return (
        docs.select(key, F.posexplode_outer(F.expr(items)).alias("seq", "f"))
        .where("f is not null")
        .select(key, "seq", *[f"f.{name}" for name in shown])
    )
