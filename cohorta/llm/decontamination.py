"""Benchmark decontamination by greedy string tiling (operator 5).

Tokens are white-space words, lower-cased, letters and digits only.  Shared
``MIN_MATCH``-token seeds (rolling Karp-Rabin hashes) bring a document and a
benchmark item together; tiling then marks the longest match free on both
sides, again and again, until none of ``MIN_MATCH`` tokens is left.  Tiles may
lie in any order, so reordered passages count.  A document is contaminated by
an item when tiles cover at least ``MIN_COVER`` of the item's tokens.

A document that repeats itself at once (one word, or a few in turn, a million
times) matches an item at all its places.  Tiles use no more of it than the
item is long, so such a run is shortened first, by whole periods in its
middle, to a few lengths of the longest item; and tiling ends when the item
has no ``MIN_MATCH`` free tokens in a row.

A benchmark of up to ``LOCAL_TOKENS`` tokens (counted, not assumed) goes to
every task and documents are judged where they are read; a larger one is
joined on seeds.

Rows in, defined results: null or empty texts and items match nothing; items
shorter than ``MIN_MATCH`` tokens are too short to tell and match nothing;
repeated items and documents are reported each; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored
from cohorta.llm.tokens import hash_strings, mix, slices, text_column, words

MIN_MATCH = 4
MIN_COVER = 0.5
LOCAL_TOKENS = 1_000_000
#: Seed matches expanded at once (one document's at least).
MATCHES = 1 << 20
#: A periodic run of a document longer than so many of the longest item is shortened to that.
RUN_ITEMS = 4
PERIODS = 8
_B = np.uint64(0x2545F4914F6CDD1D)
_B_INV = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2 ** 64))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit token codes, offsets) of each text."""
    w = words(texts)
    bare = pc.replace_substring_regex(pc.utf8_lower(w.vocab), r"[^\p{L}\p{N}]+", "")
    code = hash_strings(bare)[w.ids] if len(w.vocab) else np.zeros(0, np.uint64)
    keep = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[w.ids] if len(w.vocab) else np.zeros(0, bool)
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[w.offsets]


def karp_rabin(code: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of the ``k`` tokens from each place (also across documents; mask those)."""
    n = len(code)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _B, np.uint64)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - k, _B_INV, np.uint64)]))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code * power, out=total[1:])
        return mix((total[k:] - total[:-k]) * inverse)


def seeds(code: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the document, hash) of every seed."""
    key = karp_rabin(code, k)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(key)]
    ok = np.arange(len(key)) + k <= offsets[doc + 1]
    at = np.flatnonzero(ok)
    return doc[at], at - offsets[doc[at]], key[at]


def tile(item: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> tuple[int, int]:
    """(tiles, tokens covered) of greedy string tiling from the seed matches (p in item, q in doc)."""
    true = np.ones(len(p), bool)
    for j in range(k):
        true &= item[p + j] == doc[q + j]
    p, q = p[true], q[true]
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    if not len(p):
        return 0, 0
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(q - p) != 0) | (np.diff(p) != 1)]))
    run = np.diff(np.append(edge, len(p))) + k - 1
    first = np.lexsort((q[edge], p[edge], -run))         # longest first, then by place in the item and the document
    whole = iter(zip((-run[first]).tolist(), p[edge][first].tolist(), q[edge][first].tolist()))
    heap: list[tuple[int, int, int]] = []                # what is left of matches that met a tile
    following = next(whole, None)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    count = covered = 0
    room = True
    while room and (heap or following):
        if heap and (following is None or heap[0] < following):
            n, a, b = heapq.heappop(heap)
        else:
            (n, a, b), following = following, next(whole, None)
        n = -n
        taken = in_item[a:a + n] | in_doc[b:b + n]
        if not taken.any():
            in_item[a:a + n] = in_doc[b:b + n] = True
            count, covered = count + 1, covered + n
            free = np.diff(np.flatnonzero(np.concatenate([[True], in_item, [True]]))) - 1
            room = bool((free >= k).any())
            continue
        # what is left free goes back as shorter matches
        free = np.flatnonzero(np.diff(np.concatenate([[0], (~taken).astype(np.int8), [0]])))
        for s, e in zip(free[::2].tolist(), free[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return count, covered


def shorten(code: np.ndarray, off: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens without the middle of long periodic runs; a run keeps ``RUN_ITEMS`` lengths of the longest item."""
    most = RUN_ITEMS * max(longest, MIN_MATCH)
    for period in range(1, PERIODS + 1):
        if not (np.diff(off) > most + period).any():
            break
        same = np.zeros(len(code) + 1, np.int8)
        same[1:len(code) - period + 1] = code[period:] == code[:-period]
        # a run ends with its document
        for back in range(period):
            same[np.maximum(off[1:] - back, 0)] = 0
        edge = np.flatnonzero(np.diff(same, append=np.int8(0)))
        start, size = edge[::2], edge[1::2] - edge[::2]
        long = size + period > most + period
        if not long.any():
            continue
        start, size = start[long], size[long] + period
        drop = (size - most) // period * period
        at = start + most // 2
        edges = np.zeros(len(code) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + drop, -1)
        keep = np.cumsum(edges[:-1]) == 0
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        code = code[keep]
    return code, off


class Items:
    """Benchmark tokens with a seed lookup."""

    def __init__(self, ids: pa.Array, texts: pa.Array, k: int) -> None:
        self.ids, self.k = ids, k
        self.code, self.offsets = tokens(texts)
        self.size = np.diff(self.offsets)
        owner, place, key = seeds(self.code, self.offsets, k)
        order = np.argsort(key, kind="stable")
        self.owner, self.place, self.key = owner[order], place[order], key[order]
        self.some = np.zeros(1 << 20, bool)
        self.some[key >> np.uint64(44)] = True

    def matches(self, texts: pa.Array, cover: float) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, tiles, tokens covered) of each contaminated pair of a slice."""
        code, off = shorten(*tokens(texts), int(self.size.max(initial=0)))
        doc, place, key = seeds(code, off, self.k)
        maybe = self.some[key >> np.uint64(44)]
        doc, place, key = doc[maybe], place[maybe], key[maybe]
        left = np.searchsorted(self.key, key, side="left")
        n = np.searchsorted(self.key, key, side="right") - left
        hit = np.flatnonzero(n)
        doc, place, left, n = doc[hit], place[hit], left[hit], n[hit]
        # whole documents, as many as MATCHES allows
        ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)) if len(doc) else np.zeros(0, np.int64)
        upto, begin = np.cumsum(n), 0
        while begin < len(doc):
            before = upto[begin - 1] if begin else 0
            fits = ends[(ends > begin) & (upto[ends - 1] - before <= MATCHES)]
            stop = int(fits[-1]) if len(fits) else int(ends[ends > begin][0])
            some = slice(begin, stop)
            yield from self._judged(code, off, doc[some], place[some], left[some], n[some], cover)
            begin = stop

    def _judged(self, code: np.ndarray, off: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray,
                n: np.ndarray, cover: float) -> Iterator[tuple[int, int, int, int]]:
        k = self.k
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        doc, q = np.repeat(doc, n), np.repeat(place, n)
        item, p = self.owner[at], self.place[at]
        order = np.lexsort((p, item, doc))
        doc, q, item, p = doc[order], q[order], item[order], p[order]
        pair = doc * np.int64(len(self.size)) + item
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        fresh = np.ones(len(pair), np.int64)
        fresh[1:] = (pair[1:] != pair[:-1]) | (p[1:] != p[:-1])
        distinct = np.add.reduceat(fresh, edge) if len(edge) else fresh
        for e, stop, c in zip(edge, np.append(edge[1:], len(pair)), distinct):
            i, d = int(item[e]), int(doc[e])
            need = cover * self.size[i]
            if c * k < need:                     # seeds at c places cover c * k tokens at most
                continue
            tiles, covered = tile(self.code[self.offsets[i]:self.offsets[i + 1]], code[off[d]:off[d + 1]],
                                  p[e:stop], q[e:stop], k)
            if covered >= need - 1e-9 and tiles:
                yield d, i, tiles, covered


RESULT = "item_id long, n_tiles int, covered long, item_tokens long, coverage double"


def _count_tokens(table: DataFrame) -> int:
    return int(table.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, cover: float = MIN_COVER,
                 local_tokens: int = LOCAL_TOKENS) -> DataFrame:
    """One row per contaminated (document, item): doc_id and ``RESULT`` columns."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _count_tokens(items) <= local_tokens:
        return _local(rows, ["doc_id"], items, k, cover)
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "tiling-rows")
    found = _joined(numbered, items, k, cover)
    return found.join(numbered.select("row", "doc_id"), "row").drop("row").select("doc_id", *found.columns[1:])


def _held(items: DataFrame, k: int):
    """Function that gives a task the benchmark, whose size is checked, with its seeds."""
    table = items.toArrow()
    shared = items.sparkSession.sparkContext.broadcast(
        (table.column("item_id").to_pylist(), table.column("text").to_pylist()))

    def build() -> Items:
        ids, texts = shared.value
        return Items(pa.array(ids, pa.int64()), pa.array([t or "" for t in texts], pa.large_string()), k)

    return build


def _local_clean(packed: DataFrame, items: DataFrame, k: int, cover: float) -> DataFrame:
    """Rows of ``doc`` that no item contaminates, judged where they are read."""
    build = _held(items, k)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = build()
        for batch in batches:
            for piece in slices(batch):
                bad = [d for d, *_ in it.matches(text_column(piece), cover)]
                keep = np.ones(piece.num_rows, bool)
                keep[bad] = False
                yield pa.RecordBatch.from_arrays([piece.column("doc").filter(pa.array(keep))], ["doc"])

    rows = packed.select("doc", F.col("doc.text").cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc {packed.schema['doc'].dataType.simpleString()}")


def _local(rows: DataFrame, carry: list[str], items: DataFrame, k: int, cover: float) -> DataFrame:
    """Judge each document against a benchmark of checked size, held by every task."""
    build = _held(items, k)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = build()
        for batch in batches:
            for piece in slices(batch):
                got = np.array(list(it.matches(text_column(piece), cover)), np.int64).reshape(-1, 4)
                if not len(got):
                    continue
                d, i, n, c = got.T
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(x).take(pa.array(d)) for x in carry), it.ids.take(pa.array(i)),
                     pa.array(n.astype(np.int32)), pa.array(c), pa.array(it.size[i]), pa.array(c / it.size[i])],
                    [*carry, "item_id", "n_tiles", "covered", "item_tokens", "coverage"])

    return rows.mapInArrow(judge, ", ".join(f"{c} long" for c in carry) + ", " + RESULT)


def _joined(numbered: DataFrame, items: DataFrame, k: int, cover: float) -> DataFrame:
    """(row, RESULT) by a join on seeds; both sides keep each seed of a text once."""
    listed = stored(items.withColumn("item", F.monotonically_increasing_id()), "tiling-items")

    def seeded(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    code, off = tokens(text_column(piece))
                    doc, _, key = seeds(code, off, k)
                    size = np.diff(off)
                    order = np.lexsort((key, doc))
                    d, h = doc[order], key[order]
                    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
                    d, h = d[new], h[new]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(name).take(pa.array(d)), pa.array(h.view(np.int64)), pa.array(size[d])],
                        [name, "seed", f"{name}_size"])
        return run

    in_items = listed.select("item", "text").mapInArrow(seeded("item"), "item long, seed long, item_size long")
    in_docs = numbered.select("row", "text").mapInArrow(seeded("row"), "row long, seed long, row_size long")
    pairs = (in_docs.select("row", "seed").join(in_items, "seed").groupBy("row", "item")
             .agg(F.count("*").alias("shared"), F.first("item_size").alias("size")))
    # an item that repeats a seed holds fewer distinct seeds than places: bound by all its places then
    repeats = in_items.groupBy("item").agg(F.count("*").alias("kinds"))
    pairs = (pairs.join(repeats, "item")
             .filter((F.col("shared") * k >= F.lit(cover) * F.col("size"))
                     | (F.col("kinds") < F.col("size") - F.lit(k - 1)))
             .select("row", "item"))
    whole = (pairs.join(listed.select("item", "item_id", F.col("text").alias("item_text")), "item")
             .join(numbered.select("row", "text"), "row"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                for r in range(piece.num_rows):
                    one = piece.slice(r, 1)
                    it = Items(one.column("item_id"), text_column(one, "item_text"), k)
                    for _, _, n, c in it.matches(text_column(one), cover):
                        yield pa.RecordBatch.from_arrays(
                            [one.column("row"), one.column("item_id"), pa.array([n], pa.int32()), pa.array([int(c)]),
                             pa.array(it.size), pa.array([c / it.size[0]])],
                            ["row", "item_id", "n_tiles", "covered", "item_tokens", "coverage"])

    return whole.mapInArrow(judge, "row long, " + RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, cover: float = MIN_COVER,
               local_tokens: int = LOCAL_TOKENS) -> DataFrame:
    """Rows contaminated by no item, all columns as they were."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if _count_tokens(items) <= local_tokens:
        return _local_clean(packed, items, k, cover).select("doc.*")
    rows = stored(packed.withColumn("row", F.monotonically_increasing_id()), "tiling-rows")
    found = _joined(rows.select("row", F.col("doc.text").cast("string").alias("text")), items, k, cover)
    return rows.join(found.select("row").distinct(), "row", "left_anti").select("doc.*")
