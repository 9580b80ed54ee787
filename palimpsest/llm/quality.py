"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit b says
that rule b failed. A policy is a named, versioned mask of the rules that count; applying one is a bitwise
and, so a new policy never reads the texts again. An ablation (how many documents each rule alone costs)
comes from counts per distinct pattern of bits.

Defined results: a null text is an empty one and fails the base rules; equal rows are measured alike; other
columns stay as they are. Measures are taken per document inside a task, in memory that grows with one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_chars", "n_capital_words", "n_marked_words", "n_distinct_words", "most_common_word",
)
SYMBOLS = b"#*$%&|<>"
MARKS = (b"!!", b"??", b"?!", b"!?")

#: Bit, name and failing condition of every rule; conditions see the measures as columns.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "2 * n_symbols > n_words"),
    (3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
    (6, "capitals", "2 * n_capital_words > n_words"),
    (7, "marks", "2 * n_marked_words > n_words"),
    (8, "one_word", "100 * most_common_word > 40 * n_words"),
    (9, "poor_vocabulary", "n_words >= 50 and n_distinct_words * n_distinct_words < 2 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Rules of each policy version; documents keep the verdict of the version they are judged by.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "capitals", "marks", "one_word", "poor_vocabulary"),
}


def _measure(text: bytes | None) -> list[int]:
    text = text or b""
    words = text.split()  # bytes split at ASCII white space only
    n = len(words)
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    raw = np.frombuffer(text, np.uint8)
    per_byte = np.bincount(raw, minlength=256)
    chars = len(text) - int(per_byte[0x80:0xC0].sum())  # continuation bytes don't count
    blank = int(per_byte[[9, 10, 11, 12, 13, 32]].sum())
    lines = [line for line in text.split(b"\n") if line.split()]
    times = np.bincount(codes, minlength=len(ids)) if n else np.zeros(0, np.int64)
    capital = sum(int(times[k]) for w, k in ids.items() if len(w) > 1 and (w.isupper() if w.isascii() else _in_capitals(w.decode())))
    marked = sum(int(times[k]) for w, k in ids.items() if w.endswith(MARKS))
    return [
        n, chars - blank, int(sum(per_byte[s] for s in SYMBOLS)), len(lines) - len(set(lines)), _in_repeats(codes, len(ids)),
        len(lines), chars, capital, marked, len(ids), int(times.max()) if n else 0,
    ]


def _in_capitals(word: str) -> bool:
    """Two letters or more, none of which has a capital form of its own length and one of which has a small one."""
    other = lambda c, form: len(form) == 1 and form != c
    return len(word) > 1 and not any(other(c, c.upper()) for c in word) and any(other(c, c.lower()) for c in word)


def _in_repeats(codes: np.ndarray, kinds: int, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    if len(codes) < size:
        return 0
    n = len(codes) - size + 1
    window = codes[:n]
    for k in range(1, size):
        if int(window.max()) >= 2**62 // max(kinds, 1):  # number the windows so far anew, so that the next pair fits one long
            window = np.unique(window, return_inverse=True)[1]
        window = window * kinds + codes[k : n + k]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    place = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice[place] == window)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([_measure(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(MEASURES))
        columns = [*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(len(MEASURES)))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *MEASURES])


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, all measures and ``failed`` (a long with a bit per failed rule). Reads each text once."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = ", ".join([*([fields] if keep else []), *(f"{m} long" for m in MEASURES)])
    measured = docs.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(_measured, schema)
    return measured.withColumn("failed", failure_bits())


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for bit, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(rules: tuple[str, ...]) -> int:
    numbers = {name: bit for bit, name, _ in RULES}
    return sum(1 << numbers[name] for name in rules)


def verdicts(entries: DataFrame) -> DataFrame:
    """``entries`` with ``kept_<version>`` for every policy, and ``only_rule``, the bit of the rule that alone failed (null otherwise)."""
    kept = {f"kept_{v}": F.col("failed").bitwiseAND(F.lit(mask(rules))) == 0 for v, rules in POLICIES.items()}
    alone = F.when(F.bit_count("failed") == 1, F.log2("failed").cast("int"))
    return entries.withColumns(kept | {"only_rule": alone})


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """``entries`` with ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents it alone fails, documents kept without it."""
    whole = mask(POLICIES[version])
    numbers = {name: bit for bit, name, _ in RULES}
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << numbers[name]).cast("long").alias("bit")) for name in POLICIES[version]]
    each = patterns.withColumn("r", F.explode(F.array(*rules)))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(bit.bitwiseXOR(F.lit(whole))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
