"""Chat formatting with the cheapest repair of the order of roles.

A finite automaton says which role may follow which: an optional system turn first, then user and assistant
in turn. Each turn is kept, relabelled, merged into the turn before it, or preceded by inserted empty turns,
and the sequence of these choices with the least total cost is taken. The repaired turns are then rendered.

A turn is a 3 x 3 table of costs from the last role before it to the last role after it (min-plus algebra),
so stretches of turns can be folded apart and their tables combined. Long conversations are therefore cut
into blocks of at most ``BLOCK`` turns: every block is folded by itself, the tables of a conversation's blocks
are combined from the front and from the back, and each block then finds its own part of the cheapest path.

Defined results: roles are compared in lower case without outer white space; unknown or null roles fit no
legal role and are relabelled at no cost; null texts are empty; turns go by ``turn`` (null first), then by role and
text; rows that are equal are separate turns; conversations with a null id are one conversation; ties between
repairs go to the first in the order keep, merge, relabel, insert; other columns are not carried.

One row per output piece: an input turn, or an inserted empty turn. Pieces merged into one turn share
``out_turn``; concatenating ``rendered`` by ``piece`` gives the text of the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

ROLES = ("system", "user", "assistant")
START = 3  # the state before the first turn
#: May the column's role follow the row's? The last row is the start of a conversation.
LEGAL = np.array([[False, True, False], [False, False, True], [False, True, False], [True, True, False]])
#: States a conversation may end in.
FINAL = np.array([False, True, True])
COSTS = {"merge": 1.0, "relabel": 2.0, "insert": 3.0, "system_merge": 0.5}
BLOCK = 2048
#: Turns handled in one call, about.
GROUP = 8192
HEADER, FOOTER = "<|{role}|>\n", "<|end|>\n"
OTHER = 3  # code of a role that is none of ROLES
FAR = 1e15


def _options(costs: dict[str, float]) -> dict[int, list[tuple[float, int, int, str, tuple[int, ...]]]]:
    """For each given role, the moves: cost, state before, state after, action, roles of inserted turns.

    A move from one state to another is written once, with the cheapest way to do it.
    """
    paths: dict[tuple[int, int], tuple[int, ...]] = {}
    for before in range(4):
        for after in range(3):
            if LEGAL[before, after]:
                paths[before, after] = ()
            else:
                between = [(m,) for m in range(3) if LEGAL[before, m] and LEGAL[m, after]]
                between += [(m, k) for m in range(3) for k in range(3) if LEGAL[before, m] and LEGAL[m, k] and LEGAL[k, after]]
                if between:
                    paths[before, after] = between[0]
    out: dict[int, list[tuple[float, int, int, str, tuple[int, ...]]]] = {}
    for given in range(4):
        best: dict[tuple[int, int], tuple[float, int, str, tuple[int, ...]]] = {}
        for before in range(4):
            for after in range(3):
                change = 0.0 if given in (after, OTHER) else costs["relabel"]
                ways = []
                if (before, after) in paths:
                    more = paths[before, after]
                    action = "insert" if more else "keep" if given == after else "relabel"
                    ways.append((change + costs["insert"] * len(more), {"keep": 0, "relabel": 2, "insert": 3}[action], action, more))
                if before == after:
                    ways.append((change + costs["system_merge" if after == 0 else "merge"], 1, "merge", ()))
                if ways:
                    best[before, after] = min(ways)
        out[given] = [(cost, before, after, action, more) for (before, after), (cost, _, action, more) in sorted(best.items())]
    return out


def _tables(options: dict) -> np.ndarray:
    """Costs by given role, state before and state after."""
    tables = np.full((4, 4, 3), FAR)
    for given, moves in options.items():
        for cost, before, after, _, _ in moves:
            tables[given, before, after] = cost
    return tables


def _fold(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Costs of a stretch, from each of the 4 states before it to each of the 3 after it."""
    table = tables[codes[0]].copy()
    for code in codes[1:]:
        table = (table[:, :, None] + tables[code][None, :3, :]).min(axis=1)
    return table


def repair(codes: list[int], enter: list[float], leave: list[float], options: dict) -> list[tuple[int, str, tuple[int, ...]]]:
    """The cheapest path through a stretch, given costs of the states before (4) and after it (3).

    For each turn: its role, the action and the roles of the empty turns inserted before it.
    """
    now = list(enter)
    back: list[list[tuple[int, str, tuple[int, ...]] | None]] = []
    for code in codes:
        after: list[float] = [FAR] * 3 + [FAR * 2]
        came: list[tuple[int, str, tuple[int, ...]] | None] = [None] * 3
        for cost, before, state, action, more in options[code]:
            if now[before] + cost < after[state]:
                after[state], came[state] = now[before] + cost, (before, action, more)
        now = after
        back.append(came)
    state = min(range(3), key=lambda s: now[s] + leave[s])
    path = []
    for came in reversed(back):
        before, action, more = came[state]
        path.append((state, action, more))
        state = before
    return path[::-1]


def _starts(rows: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where sorted rows begin a new key."""
    new = np.zeros(len(rows), bool)
    for key in keys:
        values = rows[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    new[:1] = True
    return np.flatnonzero(new).tolist()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the turns of sorted conversations inside a task and cut them into blocks."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, count = object(), 0
    for rows in batches:
        new = rows["conv"].ne(rows["conv"].shift())
        starts = np.flatnonzero(new)
        place = np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))
        if len(rows) and rows["conv"].iloc[0] == last:
            place[: starts[1] if len(starts) > 1 else len(rows)] += count
        if len(rows):
            last, count = rows["conv"].iloc[-1], int(place[-1]) + 1
        yield rows.assign(part=part, block=place // BLOCK, place=place)


def formatted(
    turns: DataFrame, costs: dict[str, float] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Columns conv_id, piece, turn, given_role, role, action (keep, merge, relabel, insert, inserted), out_turn, rendered."""
    options = _options(COSTS | (costs or {}))
    tables = _tables(options)
    name = F.lower(F.trim(F.col(role)))
    code = F.lit(OTHER)
    for k, known in enumerate(ROLES):
        code = F.when(name == known, k).otherwise(code)
    base = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("number"), F.col(turn).cast("string").alias("turn"),
        F.col(role).cast("string").alias("given_role"), code.alias("code"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range of this order may end inside a long conversation, so no task need hold one
    order = ["conv", "number", "code", "given_role", "text", "at"]
    ordered = base.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "turn", "given_role", "code", "text")
    schema = "conv string, turn string, given_role string, code int, text string, part int, block long, place long"
    blocks = written(ordered.mapInPandas(_cut, schema), "turns")

    groups = max(1, blocks.count() // GROUP)  # of whole blocks, so many small conversations share a call

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conv", "part", "block", "place"], ignore_index=True)
        starts = _starts(rows, ["conv", "part", "block"])
        codes = rows["code"].to_numpy()
        folded = [_fold(codes[a:b], tables).ravel().tolist() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
        return rows.loc[starts, ["conv", "part", "block"]].assign(table=folded)

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conv", "part", "block"], ignore_index=True)
        folded = np.array(rows["table"].tolist()).reshape(-1, 4, 3)
        first, last = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        starts = _starts(rows, ["conv"])
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            leave = [np.where(FINAL, 0.0, FAR / 4)]
            for table in folded[b - 1 : a : -1]:
                leave.append((table[:3] + leave[-1]).min(axis=1))
            state = START
            for k in range(a, b):
                first[k] = state
                last[k] = state = int((folded[k][state] + leave[b - 1 - k]).argmin())
        return rows[["conv", "part", "block"]].assign(first=first, last=last)

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conv", "part", "block", "place"], ignore_index=True)
        starts = _starts(rows, ["conv", "part", "block"])
        codes, path = rows["code"].tolist(), []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            enter, leave = [FAR] * 4, [FAR] * 3
            enter[rows.at[a, "first"]] = leave[rows.at[a, "last"]] = 0.0
            path += repair(codes[a:b], enter, leave, options)
        found = {"state": [p[0] for p in path], "action": [p[1] for p in path], "more": [list(p[2]) for p in path]}
        return rows[["conv", "turn", "given_role", "text", "part", "place"]].assign(**found)

    keys = ["conv", "part", "block"]
    group = lambda *by: F.pmod(F.xxhash64(*by), F.lit(groups)).alias("group")
    folded = written(
        blocks.select(*keys, "place", "code").groupBy(group(*keys)).applyInPandas(fold, "conv string, part int, block long, table array<double>"), "tables"
    )
    ends = folded.groupBy(group("conv")).applyInPandas(borders, "conv string, part int, block long, first int, last int")
    done = blocks.join(ends, keys).groupBy(group(*keys)).applyInPandas(
        follow, "conv string, turn string, given_role string, text string, part int, place long, state int, action string, more array<int>"
    )
    return _rendered(done)


def _rendered(done: DataFrame) -> DataFrame:
    """Number the output turns over all blocks and write headers and footers.

    Numbers inside a part come from a window over (conversation, part), and offsets from sums per part.
    """
    from pyspark.sql import Window

    opens = (F.col("action") != "merge").cast("long") + F.size("more")
    pieces = F.lit(1) + F.size("more")
    sums = done.groupBy("conv", "part").agg(F.sum(opens).alias("opens"), F.sum(pieces).alias("pieces"), F.min(F.struct("place", F.col("action") == "merge"))["col2"].alias("begins"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv", "part", F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("turns0"), F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("pieces0"),
        F.lead("begins").over(Window.partitionBy("conv").orderBy("part")).alias("goes_on"),
    )
    inside = Window.partitionBy("conv", "part").orderBy("place")
    numbered = done.join(sums, ["conv", "part"]).select(
        "*",
        (F.col("turns0") + F.sum(opens).over(inside)).alias("number"),
        (F.col("pieces0") + F.sum(pieces).over(inside)).alias("last_piece"),
        F.coalesce(F.lead(F.col("action") == "merge").over(inside), F.col("goes_on"), F.lit(False)).alias("stays"),
    )
    names = F.array(*(F.lit(r) for r in ROLES))
    own = F.get(names, F.col("state"))
    header = lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n"))
    text = F.concat(F.when(F.col("action") == "merge", F.lit("\n")).otherwise(header(own)), F.col("text"), F.when(F.col("stays"), F.lit("")).otherwise(F.lit("\n" + FOOTER)))
    turn = F.struct(
        F.col("last_piece").alias("piece"), F.col("turn"), F.col("given_role"), own.alias("role"), F.col("action"), F.col("number").alias("out_turn"), text.alias("rendered")
    )
    put_in = F.transform(
        "more",
        lambda r, k: F.struct(
            (F.col("last_piece") - F.size("more") + k).alias("piece"), F.lit(None).cast("string").alias("turn"), F.lit(None).cast("string").alias("given_role"),
            F.get(names, r).alias("role"), F.lit("inserted").alias("action"), (F.col("number") - F.size("more") + k).alias("out_turn"),
            F.concat(header(F.get(names, r)), F.lit("\n" + FOOTER)).alias("rendered"),
        ),
    )
    pieces = numbered.select("conv", F.explode(F.concat(put_in, F.array(turn))).alias("p")).select("conv", "p.*")
    conv_id = F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")
    return pieces.select(conv_id, "piece", F.col("turn").cast("long"), "given_role", "role", "action", "out_turn", "rendered")
