"""Hard-negative mining over Hilbert-ordered blocks with zone maps (operator 13).

A row's vector is ``floor(256 x)`` of its components.  All rows are ordered
along a Hilbert curve through their projections on a few directions (fitted
on a bounded sample; they only order rows) and written as Parquet files whose
row groups are the blocks.  Beside each file lie its zone maps: the least and
greatest value of every dimension in each block.  A block's zone bounds its
rows' inner products with an anchor by interval arithmetic, so an anchor reads

* for its positives: blocks that may hold a score above its 5th best so far;
* for its negatives: blocks whose interval meets one of its score windows
  above the third best found in it.

Files are bounded by their own zone first, blocks in the order of their upper
bounds.  Nothing is approximated: a block is left out only if its bounds
exclude it.  Scores are exact: in doubles while every sum stays below 2^53,
in Python's integers beyond; scores beyond 64 bits are returned as the
nearest 64-bit number.

Rows in, defined results: rows with a null label, vector or vec_id, or a null or
non-finite component take no part; shorter vectors are filled up with zeros;
repeated rows are rows of their own (none is "another row" to an anchor of
the same vec_id), and each repeat of an anchor is mined; ties go to the
smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import file_system, shared_folder

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score between which a negative's score must lie.
LOW, HIGH = 50, 95
BLOCK_ROWS = 256
FILE_BLOCKS = 1024
#: Rows that the directions of the curve are fitted on.
SAMPLE_ROWS = 4096
DIRECTIONS, BITS = 8, 7
ANCHORS_PER_TASK = 64
#: Bytes of blocks that a task keeps for the next anchors.
CACHE_BYTES = 32 << 20
EXACT = float(1 << 53)
FIELDS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2^bits a column)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    if not x:
        return np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:                                   # undo the turns of each level
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = x[0] ^ np.where(flip, q - 1, swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, len(x)):                     # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    out = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | (axis ^ turn) >> b & 1
    return out


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """List column as a matrix of ``dim`` columns, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


class Curve:
    """Directions, ranges and cells of the curve, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray) -> None:
        self.middle = sample.mean(axis=0)
        _, _, axes = np.linalg.svd(np.clip(sample - self.middle, -1e100, 1e100), full_matrices=False)
        self.axes = axes[:DIRECTIONS].T
        at = (sample - self.middle) @ self.axes
        self.low, high = np.quantile(at, [0.005, 0.995], axis=0)
        self.step = np.maximum(high - self.low, 1e-9) / (1 << BITS)

    def key(self, matrix: np.ndarray) -> np.ndarray:
        at = ((matrix - self.middle) @ self.axes - self.low) / self.step
        return hilbert(np.clip(np.nan_to_num(at), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (after the re-labelling), vector of the rows that take part."""
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                             F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
            .withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def keyed(rows: DataFrame, dim: int, curve: Curve) -> DataFrame:
    """vec_id, label, vector (whole numbers) and the place on the curve."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.floor(SCALE * vectors(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), as_lists(matrix), pa.array(curve.key(matrix))],
                ["vec_id", "label", "vector", "key"])

    return rows.mapInArrow(key, "vec_id long, label long, vector array<double>, key long")


def as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(matrix.reshape(-1)))


def write_blocks(rows: DataFrame, dim: int, folder: str) -> DataFrame:
    """Write files of blocks along the curve; one row per file: path, rows, low and high of each dimension.

    Each attempt writes files of its own; only those that the returned (stored) table names count."""
    order = ["key", "vec_id", "salt"]
    ranged = (rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
              .repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "vector"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for ids, labels, matrix in regroup(batches, dim, BLOCK_ROWS * FILE_BLOCKS):
            name = uuid.uuid4().hex
            table = pa.table({"vec_id": ids, "label": labels, "vector": as_lists(matrix)})
            with fs.open_output_stream(f"{base}/{name}.parquet") as out:
                pq.write_table(table, out, row_group_size=BLOCK_ROWS, compression="zstd", use_dictionary=False,
                               write_statistics=False)
            starts = np.arange(0, len(ids), BLOCK_ROWS)
            low, high = np.minimum.reduceat(matrix, starts), np.maximum.reduceat(matrix, starts)
            zones = pa.table({"low": as_lists(low), "high": as_lists(high),
                              "least_label": np.minimum.reduceat(labels, starts),
                              "most_label": np.maximum.reduceat(labels, starts)})
            with fs.open_output_stream(f"{base}/{name}.zones") as out:
                pq.write_table(zones, out, compression="zstd")
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(ids)]), as_lists(low.min(axis=0)[None]), as_lists(high.max(axis=0)[None])],
                ["name", "rows", "low", "high"])

    return ranged.mapInArrow(write, "name string, rows long, low array<double>, high array<double>")


def regroup(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple]:
    """(ids, labels, matrix) of ``rows`` rows at a time, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), vectors(batch.column("vector"), dim)))
        n += batch.num_rows
        while n >= rows:
            ids, labels, matrix = (np.concatenate(x) for x in zip(*held))
            yield ids[:rows], labels[:rows], matrix[:rows]
            held, n = [(ids[rows:], labels[rows:], matrix[rows:])], n - rows
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


class Blocks:
    """The files of one manifest: zones and blocks, the latest of them kept."""

    def __init__(self, folder: str, manifest: str) -> None:
        import pyarrow.parquet as pq
        self.fs, self.base = file_system(folder)
        fs, path = file_system(manifest)
        table = pq.read_table(path, filesystem=fs).combine_chunks()
        self.names = table.column("name").to_pylist()
        self.dim = len(table.column("low")[0])
        self.low, self.high = (vectors(table.column(c).combine_chunks(), self.dim) for c in ("low", "high"))
        self.most = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))
        self.n_blocks = int((-(-table.column("rows").to_numpy() // BLOCK_ROWS)).sum())
        self.kept: OrderedDict[tuple[int, int], tuple] = OrderedDict()
        self.kept_bytes = 0
        self.read: set[tuple[int, int]] = set()
        self.open: dict[int, tuple] = {}

    def file(self, f: int) -> tuple:
        """(Parquet file, low, high, least label, most label) of file ``f``; a few stay open."""
        import pyarrow.parquet as pq
        if f not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open)))[0].close()
            zones = pq.read_table(self.fs.open_input_file(f"{self.base}/{self.names[f]}.zones")).combine_chunks()
            low, high = (vectors(zones.column(c).combine_chunks(), self.dim) for c in ("low", "high"))
            data = pq.ParquetFile(self.fs.open_input_file(f"{self.base}/{self.names[f]}.parquet"))
            self.open[f] = (data, low, high, zones.column("least_label").to_numpy(), zones.column("most_label").to_numpy())
        return self.open[f]

    def block(self, f: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, matrix) of a block."""
        if (f, b) not in self.kept:
            t = self.file(f)[0].read_row_group(b).combine_chunks()
            self.kept[f, b] = (t.column("vec_id").to_numpy(), t.column("label").to_numpy(),
                               vectors(t.column("vector").combine_chunks(), self.dim))
            self.read.add((f, b))
            self.kept_bytes += self.kept[f, b][2].nbytes
            while self.kept_bytes > CACHE_BYTES and len(self.kept) > 1:
                self.kept_bytes -= self.kept.popitem(last=False)[1][2].nbytes
        self.kept.move_to_end((f, b))
        return self.kept[f, b]


class Search:
    """Positives and negatives of a few anchors."""

    def __init__(self, blocks: Blocks, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        most = np.abs(matrix).max(initial=0) * blocks.most * max(blocks.dim, 1)
        self.kind = float if most < EXACT else object
        self.blocks, self.ids, self.labels = blocks, ids, labels
        self.matrix = self.exact(matrix)

    def exact(self, matrix: np.ndarray) -> np.ndarray:
        """Doubles, or Python integers if sums may leave the range where doubles are exact."""
        return matrix if self.kind is float else np.frompyfunc(int, 1, 1)(matrix).reshape(matrix.shape)

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not a.shape[1]:
            return np.zeros((len(a), len(b)))
        return a @ self.exact(b).T

    def bounds(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the anchors can have with vectors between ``low`` and ``high``."""
        a = self.matrix[who]
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return self.dots(up, low) + self.dots(down, high), self.dots(up, high) + self.dots(down, low)

    def visit(self, wanted: Callable, scan: Callable) -> None:
        """``scan`` every block that some anchor wants, likely ones first.

        ``wanted(anchors, least, greatest)`` says who needs a file or block with such bounds now."""
        every = np.arange(len(self.ids))
        least, most = self.bounds(every, self.blocks.low, self.blocks.high)
        for f in np.argsort(-most.max(axis=0).astype(float), kind="stable"):
            who = every[wanted(every, least[:, f], most[:, f])]
            if not len(who):
                continue
            _, low, high, first_label, last_label = self.blocks.file(f)
            lo, up = self.bounds(who, low, high)
            for b in np.argsort(-up.max(axis=0).astype(float), kind="stable"):
                need = wanted(who, lo[:, b], up[:, b])
                if need.any():
                    scan(who[need], int(first_label[b]), int(last_label[b]), f, b)

    def best(self, slots: int, keep: int) -> None:
        """Empty lists of the ``keep`` best (score, id) of each slot."""
        self.score = np.full((slots, keep), float("-inf"), self.kind)
        self.found = np.full((slots, keep), np.iinfo(np.int64).max)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates into the lists: higher scores first, ties by smaller id."""
        if not len(slot):
            return
        touched = np.unique(slot)
        keep = self.score.shape[1]
        owner = np.concatenate([np.repeat(touched, keep), slot])
        value = np.concatenate([self.score[touched].reshape(-1), score])
        ident = np.concatenate([self.found[touched].reshape(-1), ids])
        rank = value if self.kind is float else np.unique(value, return_inverse=True)[1]
        order = np.lexsort((ident, -rank, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        take = order[nth < keep].reshape(len(touched), keep)
        self.score[touched], self.found[touched] = value[take], ident[take]

    def positives(self) -> None:
        self.best(len(self.ids), POSITIVES)

        def wanted(who, least, most):
            return (most >= self.score[who, -1]).astype(bool)

        def scan(who, first, last, f, b):
            who = who[(self.labels[who] >= first) & (self.labels[who] <= last)]
            if not len(who):
                return
            ids, labels, matrix = self.blocks.block(f, b)
            score = self.dots(self.matrix[who], matrix)
            a, r = np.nonzero((labels == self.labels[who, None]) & (ids != self.ids[who, None])
                              & (score >= self.score[who, -1][:, None]).astype(bool))
            self.offer(who[a], score[a, r], ids[r])

        self.visit(wanted, scan)
        self.positive, self.positive_score = self.found, self.score

    def negatives(self) -> None:
        there = self.positive_score > float("-inf")
        whole = np.frompyfunc(lambda x, yes: int(x) if yes else -1, 2, 1)(self.positive_score, there)
        # LOW p <= 100 n <= HIGH p in whole numbers; an absent positive has no window
        window_low = np.where(there, -(-whole * LOW // 100), 1).astype(self.kind)
        window_high = np.where(there, whole * HIGH // 100, 0).astype(self.kind)
        some = window_low <= window_high
        self.best(len(self.ids) * POSITIVES, NEGATIVES)

        def floor_of(who):
            third = self.score.reshape(len(self.ids), POSITIVES, NEGATIVES)[who, :, -1]
            return np.maximum(window_low[who], third)

        def wanted(who, least, most):
            meets = some[who] & (most[:, None] >= floor_of(who)) & (least[:, None] <= window_high[who])
            return meets.astype(bool).any(axis=1)

        def scan(who, first, last, f, b):
            who = who[(self.labels[who] != first) | (self.labels[who] != last)]
            if not len(who):
                return
            ids, labels, matrix = self.blocks.block(f, b)
            score = self.dots(self.matrix[who], matrix)
            other, low = labels != self.labels[who, None], floor_of(who)
            slots, scores, found = [], [], []
            for j in range(POSITIVES):
                a, r = np.nonzero(other & some[who, j, None] & (score >= low[:, j, None]).astype(bool)
                                  & (score <= window_high[who, j, None]).astype(bool))
                slots.append(who[a] * POSITIVES + j)
                scores.append(score[a, r])
                found.append(ids[r])
            self.offer(np.concatenate(slots), np.concatenate(scores), np.concatenate(found))

        self.visit(wanted, scan)

    def rows(self) -> pa.RecordBatch:
        self.positives()
        self.negatives()
        slot, rank = np.nonzero(self.score > float("-inf"))
        anchor, j = np.divmod(slot, POSITIVES)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[anchor]), pa.array(self.positive[anchor, j]), pa.array((rank + 1).astype(np.int32)),
             pa.array(self.found[slot, rank]), as_long(self.positive_score[anchor, j]), as_long(self.score[slot, rank])],
            ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def as_long(values: np.ndarray) -> pa.Array:
    least, most = -(1 << 63), (1 << 63) - 1
    if values.dtype == object:
        return pa.array([min(max(int(v), least), most) for v in values], pa.int64())
    return pa.array(values.astype(np.int64))


def mine(anchors: DataFrame, folder: str, manifest: str) -> DataFrame:
    """Search the blocks for each anchor (vec_id, label, vector)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            for start in range(0, batch.num_rows, ANCHORS_PER_TASK):
                part = batch.slice(start, ANCHORS_PER_TASK)
                blocks = blocks or Blocks(folder, manifest)
                matrix = vectors(part.column("vector"), blocks.dim)
                yield Search(blocks, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix).rows()

    return anchors.mapInArrow(search, FIELDS)


def hard_negatives(embeddings: DataFrame, anchor_every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"),
                     F.count_if(F.col("vec_id") % anchor_every == 0).alias("anchors")).first()
    if not facts.anchors:
        return spark.createDataFrame([], FIELDS)
    # some SAMPLE_ROWS rows by hash of their id, never more
    sample = (rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(facts.n)) < SAMPLE_ROWS).select("vector")
              .limit(SAMPLE_ROWS).toArrow().column("vector").combine_chunks())
    found = np.floor(SCALE * vectors(sample, facts.dim)) if len(sample) else np.zeros((1, facts.dim))
    ordered = keyed(rows, facts.dim, Curve(found))
    folder, manifest = shared_folder(spark, "blocks"), shared_folder(spark, "blocks-manifest")
    write_blocks(ordered, facts.dim, folder).write.mode("overwrite").parquet(manifest)
    # neighbours on the curve want the same blocks
    anchors = (ordered.filter(F.col("vec_id") % anchor_every == 0)
               .repartitionByRange(-(-facts.anchors // ANCHORS_PER_TASK), "key", "vec_id").sortWithinPartitions("key", "vec_id")
               .select("vec_id", "label", "vector"))
    return mine(anchors, folder, manifest)


def hard_negatives_sql() -> str:
    """The contract in DuckDB SQL, every anchor against every row."""
    return """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
           from embeddings where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
      from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.*, s.other_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same
      and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
