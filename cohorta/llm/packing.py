"""Best-fit-decreasing packing of documents into fixed-length sequences (operator 10).

Pieces are at most ``capacity`` tokens, so best-fit decreasing over the whole
corpus depends only on how many pieces there are of each length.  Spark
counts them; the plan is made on that histogram (at most ``capacity``
numbers, whatever the corpus): a segment tree over remaining capacities finds
the tightest open sequences, and sequences with equal history are filled
together.  Pieces then get their place from their rank among pieces of their
length.  The number of sequences equals serial best-fit decreasing.

Rows in, defined results: a null text is empty (one end id); repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.bitpack import SLICE, with_end
from cohorta.llm.scratch import stored
from cohorta.llm.tokenizer import encoder
from cohorta.llm.tokens import slices, text_column

CAPACITY = 2048


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds the open sequences with it."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, left: int, first: int, count: int) -> None:
        self.open[left].append((first, count))
        k = left + self.size
        while k:
            self.some[k] += 1
            k >>= 1

    def take(self, left: int) -> tuple[int, int]:
        k = left + self.size
        while k:
            self.some[k] -= 1
            k >>= 1
        return self.open[left].pop()

    def tightest(self, need: int) -> int:
        """Least capacity of at least ``need`` with an open sequence, or -1."""
        k = need + self.size
        if self.some[k]:
            return need
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return -1
        while k < self.size:
            k = 2 * k if self.some[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over {length: pieces}.

    Rows (length, first rank, pieces per sequence, first sequence, offset):
    the piece of rank r goes to sequence ``first + (r - rank) // per`` at
    ``offset + (r - rank) % per * length``.  Sorted by length and rank.
    """
    tree, opened, rows = CapacityTree(capacity), 0, []
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, per = capacity, capacity // length
                first, count = opened, -(-todo // per)
                opened += count
            else:
                per = left // length
                first, count = tree.take(left)
            use = min(count, -(-todo // per))
            rows.append((length, rank, per, first, capacity - left))
            if use < count:
                tree.add(left, first + use, count - use)
            placed = min(todo, use * per)
            full, rest = divmod(placed, per)
            if full:
                tree.add(left - per * length, first, full)
            if rest:
                tree.add(left - rest * length, first + full, 1)
            rank, todo = rank + placed, todo - placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocab_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its rank among
    the pieces of its length in the task (``task``, ``nth``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(vocab_path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part_of in slices(batch, limit=SLICE):
                ids, off = with_end(*enc.encode(text_column(part_of)), end_id)
                size = np.diff(off)
                per = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                data = ids.astype("<u4").tobytes()
                at = (off[row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                count = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
                nth += seen[length]
                seen += count
                yield pa.RecordBatch.from_arrays(
                    [part_of.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(row), part)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")


def pack_sequences(docs: DataFrame, vocab_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocab_path, end_id, capacity), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    # at most ``capacity`` rows, one per length
    histogram = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - t[k, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(t[k, 3] + nth // t[k, 2]), pa.array(t[k, 4] + nth % t[k, 2] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (cut.join(first.select("length", "task", "base").hint("merge"), ["length", "task"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
