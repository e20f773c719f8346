"""CSV files whose quoted fields may hold line breaks, read by many tasks.

A task that starts in the middle of a file cannot tell whether it is inside
quotes.  But what a stretch of lines does to that question is a function of
two states (outside, inside a quoted field), and functions compose:

1. Every split of the file is scanned once and yields its end state for either
   start state.  Composing these in file order gives each split's true start.
2. If no line ends inside quotes, the file is an ordinary CSV.
3. Else each task joins the lines of its split to records.  A record that
   crosses splits leaves a piece in each; pieces, two a split at most, are put
   together by a small shuffle.  Records are parsed by ``from_csv``.

Quotes count where CSV counts them: at the start of a field and, doubled,
inside a quoted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.session import scratch_dir

#: Up to so many splits (some 25 TB) their states go to every task; beyond, lines are joined to them.
JOINED_SPLITS = 200_000


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open after ``line``, given whether one is before it."""
    at = 0
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at += 1
        at = line.find(sep + '"', at)
        if at < 0:
            return False
        inside, at = True, at + len(sep) + 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, first byte of the split, its lines) of the splits that a batch holds, in order."""
    names = batch.column("file").dictionary_encode()
    starts = batch.column("split").to_numpy()
    code = names.indices.to_numpy()
    edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(code) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield names.dictionary[int(code[a])].as_py(), int(starts[a]), batch.slice(a, b - a)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (a carriage return stays) with their file and split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, split, out, inn, odd_out, odd_inn): end state of each split from either start state, and whether some
    line ends inside quotes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, split, part in _runs(batch):
                state = found.setdefault((file, split), [False, True, False, False])
                value = part.column("value")
                quoted = pc.match_substring(value, '"').to_numpy(zero_copy_only=False).astype(bool)
                # a line without quotes leaves the state; one that is reached inside has an open end
                plain = bool((~quoted).any())
                before = list(state[:2])
                for line in value.filter(pa.array(quoted)).to_pylist():
                    for k in (0, 1):
                        state[k] = ends_inside(line, state[k], sep)
                        state[2 + k] |= state[k]
                for k in (0, 1):
                    state[2 + k] |= plain and before[k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64()),
             *(pa.array([v[k] for v in found.values()], pa.bool_()) for k in range(4))],
            ["file", "split", "out", "inn", "odd_out", "odd_inn"])

    # a split that is cut into several Arrow batches stays in one task, so it yields one row
    return lines.mapInArrow(scan, "file string, split long, out boolean, inn boolean, odd_out boolean, odd_inn boolean")


def start_states(states: DataFrame) -> DataFrame:
    """(file, split, inside, odd): the state in which each split truly starts, by composition in file order.

    After a split that ends alike from both states nothing before it matters; in between, splits that swap the
    states count.  One row per split of some 128 MB: a file's rows are few."""
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("out") == F.col("inn"), F.col("out"))
    swaps = F.when((F.col("out")) & (~F.col("inn")), 1).otherwise(0)
    # swaps up to here, and what was fixed last, relative to the swaps before it
    ranked = states.withColumn("_swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed_state = F.when(fixed.isNotNull(), F.struct(fixed.cast("int").alias("state"), F.col("_swaps").alias("swaps")))
    last = F.last(fixed_state, ignorenulls=True).over(before)
    swapped = F.coalesce(F.lag("_swaps").over(order), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    inside = ((F.coalesce(last["state"], F.lit(0)) + swapped) % 2 == 1)
    return (ranked.withColumn("inside", inside)
            .select("file", "split", "inside", F.when(F.col("inside"), F.col("odd_inn")).otherwise(F.col("odd_out")).alias("odd")))


def records(lines: DataFrame, starts: DataFrame, sep: str) -> DataFrame:
    """(file, split, nth, text) of every record; nth counts the records that start in a split."""
    fields = "file string, split long, nth long, piece string, text string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, nth, open_ = None, False, 0, []
        rows: list[tuple] = []

        def flush() -> None:
            # what is open when a split ends goes on in the next one
            if open_:
                rows.append((*here, nth, "tail" if nth >= 0 else "middle", "\n".join(open_)))
                open_.clear()

        for batch in batches:
            for file, split, part in _runs(batch):
                if (file, split) != here:
                    flush()
                    here, inside = (file, split), part.column("inside")[0].as_py()
                    nth = -1 if inside else 0       # before its first record a split finishes one of an earlier split
                for line in part.column("value").to_pylist():
                    open_.append(line)
                    inside = ends_inside(line, inside, sep) if '"' in line else inside
                    if not inside:
                        rows.append((*here, nth, "whole" if nth >= 0 else "head", "\n".join(open_)))
                        open_.clear()
                        nth += 1
                if len(rows) > 50_000:
                    yield made(rows)
                    rows = []
        flush()
        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["file", "split", "nth", "piece", "text"])

    path = scratch_dir(lines.sparkSession, "csv-records")
    starts, numbered = starts.select("file", "split", "inside"), lines.withColumn("_at", F.monotonically_increasing_id())
    if starts.count() <= JOINED_SPLITS:
        ordered = numbered.join(F.broadcast(starts), ["file", "split"])         # keeps the order of lines
    else:
        ordered = (numbered.join(starts, ["file", "split"]).repartition("file", "split")
                   .sortWithinPartitions("file", "split", "_at"))
    ordered.select("value", "file", "split", "inside").mapInArrow(join, fields).write.mode("overwrite").parquet(path)
    found = lines.sparkSession.read.schema(fields).parquet(path)
    whole = found.filter("piece = 'whole'").select("file", "split", "nth", "text")
    # a tail opens a record, the pieces after it up to the next tail belong to it
    order = Window.partitionBy("file").orderBy("split", "nth")
    pieces = found.filter("piece <> 'whole'").withColumn("record", F.sum((F.col("piece") == "tail").cast("int")).over(order))
    crossing = (pieces.groupBy("file", "record").agg(
        F.min(F.struct("split", "nth")).alias("at"),
        F.array_sort(F.collect_list(F.struct("split", "nth", "text"))).alias("parts"))
        .select("file", "at.split", "at.nth", F.array_join(F.col("parts.text"), "\n").alias("text")))
    return whole.unionByName(crossing)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, named by the header of the first file; other files' headers are passed over."""
    options = {"header": True, "inferSchema": False, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "sep": sep}
    plain = spark.read.options(**options).csv(path)
    lines = _lines(spark, path)
    kept = scratch_dir(spark, "csv-splits")
    split_states(lines, sep).write.mode("overwrite").parquet(kept)
    starts = start_states(spark.read.parquet(kept))
    if not starts.filter("odd").limit(1).count():
        return plain
    found = records(lines, starts, sep)
    text = F.regexp_replace("text", "\r$", "")
    first = found.filter((F.col("split") == 0) & (F.col("nth") == 0))
    header = first.orderBy("file").select(text.alias("text")).first()[0]
    # a header may hold line breaks itself; the plain reader ends it at the first
    names = _header(spark, header, sep, options) if "\n" in header else plain.columns
    ddl = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    rows = found.filter((F.col("split") != 0) | (F.col("nth") != 0)).select(text.alias("text")).filter(F.trim("text") != "")
    return rows.select(F.from_csv("text", F.lit(ddl), _parsing(options)).alias("r")).select("r.*")


def _parsing(options: dict) -> dict[str, str]:
    return {k: str(options[k]) for k in ("mode", "quote", "escape", "sep")}


def _header(spark: SparkSession, header: str, sep: str, options: dict) -> list[str]:
    ddl = ", ".join(f"c{i} string" for i in range(header.count(sep) + 1))
    found = spark.createDataFrame([(header,)], "text string").select(F.from_csv("text", F.lit(ddl), _parsing(options)).alias("r"))
    return [x for x in found.first().r if x is not None]
