"""Packing: documents cut and laid into token sequences of nearly equal, nearly full windows.

Karmarkar-Karp multiway differencing spreads the ends of the documents over the windows of a
block: partial partitions with the largest imbalance are merged, the fullest window of one
with the emptiest of the other. If a window comes out above the capacity, the window count
rises and the block is dealt again.

Each task packs the documents of its own input partition, block by block; nothing is
shuffled, and what it holds is one block. A sequence's number is unique because it carries
the partition's number.

Cases: a null text counts as empty; every document ends with id 1, so an empty one has that
one token; rows that repeat are packed each by itself; a null id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import column_or_null, few_rows, table
from quarry.llm.tokens import BytePairIds

CAPACITY = 2048
#: Windows in a block, and the longest piece that differencing deals: shorter pieces balance better.
BLOCK_WINDOWS, PIECE = 128, 512
#: Pieces of a block at most, and the tokens below which pieces are dealt together.
BLOCK_PIECES, GRAIN = 32_768, 16
#: Tokens for each window by which the windows of a block may differ before one overflows.
SLACK = 4
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def multiway_difference(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the indices of sizes, with sums as near to each other as differencing gets."""
    # A partial partition: the sums above its smallest one, falling, and their groups' trees; the
    # groups at the smallest sum, if they have anything. Groups that are still empty take no room.
    heap: list[tuple[int, int, list[int], list]] = [(-x, i, [x], [i]) for i, x in enumerate(sizes)]
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        # the largest of one with the smallest of the other: only where both have k groups in all do they meet
        meet = len(a) + len(b) - k
        rows = [(x, g) for x, g in zip(a, ga, strict=True)]
        if meet > 0:
            low = rows[len(a) - meet :]
            rows = rows[: len(a) - meet]
            rows += [(x + y, (g, h)) for (x, g), y, h in zip(low, reversed(b[-meet:]), reversed(gb[-meet:]), strict=True)]
            b, gb = b[:-meet], gb[:-meet]
        rows += zip(b, gb, strict=True)
        rows.sort(key=lambda r: -r[0])
        least = rows[-1][0] if len(rows) == k else 0
        # groups at the smallest sum stay in the list: they aren't empty
        heapq.heappush(heap, (-(rows[0][0] - least), tick, [x - least for x, _ in rows], [g for _, g in rows]))
        tick += 1
    out = []
    for tree in heap[0][3]:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                flat.append(x)
        out.append(flat)
    return out + [[] for _ in range(k - len(out))]


def deal(sizes: list[int], capacity: int = CAPACITY, slack: int = SLACK) -> tuple[list[list[int]], int]:
    """Groups of sizes that each fit capacity, and how many times the count had to rise."""
    total = sum(sizes)
    k, rose = max(1, -(-total // capacity)), 0
    while True:
        groups = multiway_difference(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return [g for g in groups if g], rose
        k, rose = k + 1, rose + 1


class Packer:
    """Takes documents' ids one by one and gives back rows of SCHEMA, block by block."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, windows: int = BLOCK_WINDOWS, piece: int = PIECE):
        self.next_id, self.capacity, self.windows, self.piece = first_id, capacity, windows, piece
        self.rest: list[tuple] = []  # (doc_id, start, ids, tokens of the document)
        self.held = 0

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc_id, start, ids, n in pieces:
            size = len(ids) // 4
            rows.append((doc_id, start, size, zlib.crc32(ids), n, self.next_id, offset))
            offset += size
        self.next_id += 1
        return rows

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        n = len(ids) // 4
        rows: list[tuple] = []
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            rows += self._sequence([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], n)])
        if full < n:
            self.rest.append((doc_id, full, ids[4 * full :], n))
            self.held += n - full
        return rows + (self.flush() if self.held >= self.windows * self.capacity or len(self.rest) >= BLOCK_PIECES else [])

    def flush(self) -> list[tuple]:
        """Packs what is held."""
        if not self.rest:
            return []
        # What the full windows can't take, less some slack, goes into sequences whose lengths
        # are powers of two: those need no padding.
        k = self.held // self.capacity
        spare = self.held - k * self.capacity + SLACK * k if k else self.held
        rows: list[tuple] = []
        while spare and self.rest:
            size = min(1 << (spare.bit_length() - 1), self.capacity)
            spare -= size
            taken = []
            while size:
                doc_id, start, ids, n = self.rest.pop()
                have = len(ids) // 4
                use = min(have, size)
                taken.append((doc_id, start, ids[: 4 * use], n))
                if use < have:
                    self.rest.append((doc_id, start + use, ids[4 * use :], n))
                size -= use
            rows += self._sequence(taken)
        pieces = [
            (doc_id, start + at, ids[4 * at : 4 * (at + self.piece)], n)
            for doc_id, start, ids, n in self.rest
            for at in range(0, len(ids) // 4, self.piece)
        ]
        self.rest, self.held = [], 0
        # tiny pieces go in bundles, each dealt as one
        bundles: list[list[tuple]] = []
        room = 0
        for p in pieces:
            size = len(p[2]) // 4
            if size < GRAIN and room > 0:
                bundles[-1].append(p)
                room -= size
            else:
                bundles.append([p])
                room = GRAIN - size
        if bundles:
            groups, _ = deal([sum(len(p[2]) // 4 for p in x) for x in bundles], self.capacity)
            for g in groups:
                rows += self._sequence([p for i in g for p in bundles[i]])
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every token of every document, and id 1 after each, in exactly one piece of a sequence."""
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))
    kind = T._parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = BytePairIds.shared(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=arrow)

        for b in few_rows(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += packer.add(doc_id, ids(text or "") + end)
            yield from out(rows)
        yield from out(packer.flush())

    return rows.mapInArrow(run, kind)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
