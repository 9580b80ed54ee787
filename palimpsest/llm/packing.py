"""Packing token ids into rows of a fixed length, best fit first.

Each task tokenizes its documents and packs them in pools of about ``pool_tokens`` tokens. Texts longer than
a row are split: whole rows go out at once, the remainder is packed with the other documents of the pool.
Inside a pool the pieces go from long to short into the row with the least room that still takes them; a
segment tree over the room left finds that row. Nothing is shuffled and no token is lost: ``unpack`` gives
the token ids of every document back.

A packed row holds ``ids`` (little-endian, ``row_tokens`` numbers, padded with the end token), the cumulative
segment lengths ``cu_seqlens`` (from 0 to the tokens used), ``positions`` (little-endian, from 0 again in each segment)
and for each segment the document, its number and the first token's place in the document.

Defined results: a null or empty text is one end token, so every document is in some row; equal rows are
separate documents (``doc_numbers`` tells them apart); null ids stay null; other columns are not carried;
an empty table gives no row. Memory: a pool and one document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the vocabulary: the pattern that cuts texts before merging, and the end token's id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW_TOKENS = 2048
POOL_TOKENS = 2_000_000
SCHEMA = "pack_id long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_numbers array<long>, doc_offsets array<long>"


def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def coding(vocabulary: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})


class RoomTree:
    """Which amounts of room some open row has; finds the least that is enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.some = bytearray(2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        node = self.leaves + room
        self.some[node] = there
        node >>= 1
        while node:
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]
            node >>= 1

    def at_least(self, need: int) -> int:
        """The least room of ``need`` or more, -1 if there is none."""
        node = self.leaves + need
        if self.some[node]:
            return need
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Places of ``lengths`` (each at most ``row_tokens``) by row, long pieces first."""
    tree, rows = RoomTree(row_tokens), []
    with_room: list[list[int]] = [[] for _ in range(row_tokens + 1)]
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.at_least(lengths[piece])
        if room < 0:
            row, room = len(rows), row_tokens
            rows.append([])
        else:
            row = with_room[room].pop()
            if not with_room[room]:
                tree.put(room, False)
        rows[row].append(piece)
        left = room - lengths[piece]
        if left:
            if not with_room[left]:
                tree.put(left, True)
            with_room[left].append(row)
    return rows


class _Pool:
    """Pieces waiting to be packed: tokens, document, number and offset of each."""

    def __init__(self, row_tokens: int, kind: str) -> None:
        self.row_tokens, self.kind = row_tokens, np.dtype(kind).newbyteorder("<")
        self.pieces: list[tuple[np.ndarray, int | None, int, int]] = []
        self.tokens = 0
        self.full: list[list[tuple[np.ndarray, int | None, int, int]]] = []

    def add(self, ids: np.ndarray, doc: int | None, number: int) -> None:
        for at in range(0, len(ids), self.row_tokens):
            piece = (ids[at : at + self.row_tokens], doc, number, at)
            if len(piece[0]) == self.row_tokens:
                self.full.append([piece])
            else:
                self.pieces.append(piece)
            self.tokens += len(piece[0])

    def packed(self, first: int) -> pa.RecordBatch:
        rows = self.full + [[self.pieces[k] for k in row] for row in best_fit([len(p[0]) for p in self.pieces], self.row_tokens)]
        out: list[list] = [[] for _ in range(7)]
        for n, row in enumerate(rows):
            ids = np.full(self.row_tokens, END, self.kind)
            positions = np.zeros(self.row_tokens, self.kind)
            ends = [0]
            for tokens, *_ in row:
                ids[ends[-1] : ends[-1] + len(tokens)] = tokens
                positions[ends[-1] : ends[-1] + len(tokens)] = np.arange(len(tokens))
                ends.append(ends[-1] + len(tokens))
            values = (first + n, ids.tobytes(), ends, positions.tobytes(), [p[1] for p in row], [p[2] for p in row], [p[3] for p in row])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        self.pieces, self.full, self.tokens = [], [], 0
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, pool_tokens: int = POOL_TOKENS,
    kind: str = "uint16", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Packed rows of all documents, with the columns of ``SCHEMA``. ``kind``: uint16 or uint32, for ids and positions.

    The vocabulary file is read by the driver; tasks get its 50 thousand entries.
    """
    entries = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pool = coding(entries.value), _Pool(row_tokens, kind)
        part = TaskContext.get().partitionId() << 40
        number, rows = part, part
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode_to_numpy(words.as_py() or "", disallowed_special=())
                pool.add(np.append(ids, ids.dtype.type(END)), doc, number)
                number += 1
                if pool.tokens >= pool_tokens:
                    out = pool.packed(rows)
                    rows += out.num_rows
                    yield from _slices(out)
        if pool.tokens:
            yield from _slices(pool.packed(rows))

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def unpack(packed: DataFrame, kind: str = "uint16") -> DataFrame:
    """The pieces of all documents: ``doc_id``, ``doc_number``, ``doc_offset`` and ``ids``, without the end token's padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.dtype(kind).newbyteorder("<"))
                ends = row["cu_seqlens"]
                for k, (doc, number, at) in enumerate(zip(row["doc_ids"], row["doc_numbers"], row["doc_offsets"], strict=True)):
                    rows.append((doc, number, at, ids[ends[k] : ends[k + 1]].tolist()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "doc_number", "doc_offset", "ids"])

    return packed.mapInArrow(run, "doc_id long, doc_number long, doc_offset long, ids array<int>")
