"""Spelling variants of the words of a corpus, by composing finite-state machines.

The vocabulary (words with enough letters that occur often enough) becomes a minimised acyclic acceptor. Composed with a
transducer of exactly one inserted, deleted or replaced symbol and with the acceptor again, it accepts the pairs of words
one edit apart. A state of the composition is a pair of acceptor states and the edits spent: with none spent both sides are in
one state, with one spent they read alike to the end. What a state yields after its edit depends on the state alone, so
pairs of endings are worked out once a state and shared by all prefixes that lead to it.

The composition is enumerated per initial state, so that no machine holds the whole vocabulary. Two words one edit apart and of
six letters or more share their first three letters or their last three. So the words are dealt twice: by the state that their
first ``EDGE`` letters reach, and, written backwards, by the state of their last ones; the second machine keeps only pairs
whose first letters differ. A state that more than ``CROWD`` words share is split: its words are dealt by blocks of ``EDGE``
places in which the edit may stand, each with all letters before the block and all that must be equal behind it, so a group
holds only words that differ in at most four places, whatever the vocabulary.

Variants: the form of a word is its nearest neighbour's name in frequency terms, the near word of largest count, if that count is
``RATIO`` times its own; the root is reached by following forms, whose counts grow by ``RATIO`` a step, so by pointer
doubling in a few rounds.

Defined results: null texts have no words; equal rows count twice; a row without an id is hashed as if its id were empty;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

#: A word is a maximal run of these.
RUN = r"[A-Za-zÀ-ÿ]"
LETTERS, TIMES, RATIO = 6, 5, 5
#: Letters that lead to an initial state, and places in a block.
EDGE = 3
#: Words of an initial state, above which it is split.
CROWD = 20_000
#: Words that one task composes, about: the groups of several states, one after another.
TOGETHER = 5_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimised acyclic acceptor of sorted distinct words: ``arcs`` of each state, and which states are ``final``.

    Words are added in order; the part of the last word that the next one doesn't share is minimised, bottom up, against
    the states known by their arcs and finality.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # from, letter, to: the last word's arcs that aren't minimised yet
        last = ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            self._settle(path, shared, known)
            state = path[-1][2] if path else 0
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][letter] = len(self.arcs) - 1
                path.append((state, letter, len(self.arcs) - 1))
                state = len(self.arcs) - 1
            self.final[state] = True
            last = word
        self._settle(path, 0, known)

    def _settle(self, path: list[tuple[int, str, int]], down_to: int, known: dict[tuple, int]) -> None:
        while len(path) > down_to:
            source, letter, state = path.pop()
            signature = (self.final[state], tuple(self.arcs[state].items()))
            self.arcs[source][letter] = known.setdefault(signature, state)


class Composition:
    """Acceptor, one-edit transducer and acceptor again, composed state by state as needed.

    A word with one symbol more than another, out of several equal ones in a row, counts as having the last of them
    more, so every pair is accepted along one path only. No recursion: words may be of any length.
    """

    def __init__(self, acceptor: Acceptor) -> None:
        self.arcs, self.final = acceptor.arcs, acceptor.final
        self._live: dict[tuple[int, int], bool] = {}
        self._edits: dict[int, list[tuple[str, str, int, int]]] = {}

    def _ahead(self, a: int, b: int) -> list[tuple[str, int, int]]:
        """Symbols that both states read, and where they lead."""
        one, other = self.arcs[a], self.arcs[b]
        if len(one) <= len(other):
            return [(x, to, other[x]) for x, to in one.items() if x in other]
        return [(x, one[x], to) for x, to in other.items() if x in one]

    def live(self, a: int, b: int) -> bool:
        """Whether both states accept a common ending."""
        known, todo = self._live, [(a, b) if a < b else (b, a)]
        first = todo[0]
        while todo:
            pair = todo[-1]
            if pair not in known:
                if pair[0] == pair[1] or (self.final[pair[0]] and self.final[pair[1]]):
                    known[pair] = True
                else:
                    ahead = [(x, y) if x < y else (y, x) for _, x, y in self._ahead(*pair)]
                    if any(known.get(p) for p in ahead):
                        known[pair] = True
                    elif open_ones := [p for p in ahead if p not in known]:
                        todo.append(open_ones[0])
                        continue
                    else:
                        known[pair] = False
            todo.pop()
        return known[first]

    def edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """Edits of a state's next symbol that an accepted pair can take: symbol, the other one (none where deleted), both states after."""
        found = self._edits.get(state)
        if found is None:
            found = []
            arcs = list(self.arcs[state].items())
            for k, (a, to) in enumerate(arcs):
                if (self.final[to] and self.final[state]) or any(x != a and self.live(p, q) for x, p, q in self._ahead(to, state)):
                    found.append((a, "", to, state))
                found += [(a, b, to, other) for b, other in arcs[k + 1 :] if self.live(to, other)]
            self._edits[state] = found
        return found

    def endings(self, a: int, b: int, but: str = "") -> Iterator[str]:
        """Endings that both states accept and that don't start with ``but``."""
        path: list[str] = []
        todo = [(0, "", a, b)]
        while todo:
            depth, symbol, x, y = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(symbol)
            if self.final[x] and self.final[y]:
                yield "".join(path)
            todo += [(depth + 1, s, p, q) for s, p, q in self._ahead(x, y) if (depth or s != but) and self.live(p, q)]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs."""
        path: list[str] = []
        todo = [(0, "", 0)]
        while todo:
            depth, symbol, state = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(symbol)
            for a, b, to, other in self.edits(state):
                prefix = "".join(path)
                for rest in self.endings(to, other, "" if b else a):
                    yield prefix + a + rest, prefix + b + rest
            todo += [(depth + 1, s, to) for s, to in self.arcs[state].items()]


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of the distinct ``words`` that are one edit apart, each pair once."""
    return Composition(Acceptor(sorted(words))).pairs()


def occurring(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: int = LETTERS, respelled: Column | None = None) -> DataFrame:
    """A row ``word`` per occurrence of a run of at least ``letters`` code points, A-Z in lower case.

    ``respelled`` is an expression over ``id`` and ``run`` that may change a run before it is measured.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"({RUN}{{{letters},}})"), F.lit(1))
    each = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run"))
    return each.select((F.col("run") if respelled is None else respelled).alias("word")).where(F.length("word") >= letters)


def vocabulary(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word`` and its count ``n``, for words that occur at least ``times`` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _dealt(words: DataFrame, crowd: int) -> DataFrame:
    """Groups of words: ``state`` (what they have in common), ``back`` (written backwards) and ``whole`` (an initial state, not a block)."""
    ends = F.array(
        F.struct(F.lit(False).alias("back"), F.substring("word", 1, EDGE).alias("letters")),
        F.struct(F.lit(True).alias("back"), F.substring(F.reverse("word"), 1, EDGE).alias("letters")),
    )
    dealt = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.back", "e.letters")
    sizes = dealt.groupBy("back", "letters").agg(F.count("*").alias("size"))
    dealt = dealt.join(sizes, ["back", "letters"])
    whole = dealt.where(F.col("size").between(2, crowd)).select("word", "n", "back", F.lit(True).alias("whole"), F.col("letters").alias("state"))
    # In a crowd, the edit stands in one of the blocks of places. A pair's shorter word has ``least`` letters; both words share all before
    # the block and the last ``least - (k + 1) * EDGE`` letters, if there are any.
    spelled = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    crowded = dealt.where(F.col("size") > crowd).withColumn("spelled", spelled).withColumn("least", F.explode(F.expr("array(length(word) - 1, length(word))")))
    crowded = crowded.withColumn("k", F.explode(F.expr(f"sequence(1, cast(least div {EDGE} as int))")))
    behind = F.expr(f"greatest(least - (k + 1) * {EDGE}, 0)")
    state = F.concat_ws(
        "\t", F.col("k").cast("string"), F.col("least").cast("string"), F.expr(f"substring(spelled, 1, k * {EDGE})"), F.when(behind > 0, F.expr(f"right(spelled, greatest(least - (k + 1) * {EDGE}, 0))")).otherwise("")
    )
    blocks = crowded.select("word", "n", "back", F.lit(False).alias("whole"), state.alias("state"))
    return whole.unionByName(blocks)


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """Both directions of the pairs of each group: ``word``, ``near``, ``near_n``."""
    found = []
    for (back, _, _), group in rows.groupby(["back", "whole", "state"], sort=False):
        counts = dict(zip(group["word"], group["n"], strict=True))
        if len(counts) < 2:
            continue
        for a, b in near_pairs([w[::-1] for w in counts] if back else list(counts)):
            if back:
                a, b = a[::-1], b[::-1]
                if a[:EDGE] == b[:EDGE]:
                    continue  # the other machine has it
            found += [(a, b, counts[b]), (b, a, counts[a])]
    return pd.DataFrame(found, columns=["word", "near", "near_n"]).astype({"near_n": "int64"})


def near_words(words: DataFrame, crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """Of a table ``word``, ``n``: rows ``word``, ``near``, ``near_n`` for every two words one edit apart, both ways."""
    tasks = max(1, -(-2 * words.count() // together))
    dealt = _dealt(words, crowd).withColumn("task", F.pmod(F.xxhash64("back", "whole", "state"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInPandas(_composed, "word string, near string, near_n long")
    return found.distinct()  # two words of a crowd may be in one group for several blocks


def with_forms(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n``."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    frequent = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``, by pointer doubling over the words that have a form: rounds are logarithmic in the longest chain."""
    links = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", respelled: Column | None = None, crowd: int = CROWD) -> DataFrame:
    """A row per word of the vocabulary: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    words = written(vocabulary(occurring(docs, text, doc_id, respelled=respelled)), "vocabulary")
    return with_roots(written(with_forms(words, crowd=crowd), "variants"))
