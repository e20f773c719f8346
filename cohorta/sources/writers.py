"""Sinks: ZSTD Parquet, partitioned placement, replace and append modes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession

from cohorta.session import SHUFFLES_END, settings

#: Rows of a row group, the least that one task reads.
GROUP_ROWS = 100_000
#: Compressed bytes that a sorting task is dealt, times the columns.  A sorted row takes 8 bytes for each column, NULL
#: or not, and nearly none of them in a shuffle, by whose bytes Spark sizes tasks.
SORTED_BYTES = 1 << 30


def sorted_tasks(columns: int) -> dict[str, str]:
    """Settings by which tasks that sort rows of so many columns stay small however large the input is."""
    return {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(64 << 20, SORTED_BYTES // max(columns, 1)))}


@dataclass
class Shaped:
    """Rows as they move, and the projection that makes stored rows of them where they have arrived.

    ``rows`` have the columns by which they are dealt out and looked up, none that follow from others, and are
    distinct by those."""

    rows: DataFrame
    shape: Callable[[DataFrame], DataFrame]


def write_parquet(df: DataFrame, path: str, mode: str = "append", partition_by=(),
                  max_records_per_file: int | None = None, lookup=(), file_prefix: str | None = None,
                  shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``mode='append'`` adds files; ``mode='overwrite'`` replaces only the
    partitions present in ``df`` (dynamic partition overwrite).  ``lookup``
    columns order the rows of each file and get bloom filters, so a reader
    that knows their values skips row groups and pages.  ``file_prefix`` begins
    the names of the files (``part`` otherwise).  ``shape`` makes the stored
    columns after the rows were grouped by partition value: constants and what
    follows from other columns do not move.  Shuffle files go when the write ends."""
    if partition_by:
        # group rows by partition value before writing (one file per value
        # per task otherwise: tasks x values small files); REBALANCE lets AQE
        # split a hot value over several tasks and merge tiny ones
        df = df.hint("rebalance", *partition_by)
    if shape:
        df = shape(df)
    if lookup:
        df = df.sortWithinPartitions(*partition_by, *lookup)
    w = df.write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS)
    for column in lookup:
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if file_prefix:
        w = w.option("mapreduce.output.basename", file_prefix)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with settings(df.sparkSession, SHUFFLES_END | (sorted_tasks(len(df.columns)) if partition_by else {})):
        w.parquet(path)


def observed(observation: Observation, name: str) -> int:
    """A count observed by a finished write; 0 if no row ever passed."""
    try:
        return int(observation.get.get(name) or 0)
    except (PySparkException, Py4JError):      # the plan was found empty and nothing was measured
        return 0


def delete_files(files: DataFrame) -> int:
    """Delete the files named in column ``path``; one task deletes many, a missing
    file counts as deleted.  Returns how many were named."""
    import pyarrow as pa

    def remove(batches):
        from pyarrow import fs
        for batch in batches:
            for path in batch.column("path").to_pylist():
                uri = "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path
                system, name = fs.FileSystem.from_uri(unquote(uri) if uri.startswith("file:") else uri)
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    named = files.select("path").distinct()
    return named.mapInArrow(remove, "n long").agg({"n": "sum"}).first()[0] or 0


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Names of the data files below ``path`` (a plain listing, for reports and tests)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    it = fs.listFiles(p, True)
    while it.hasNext():
        fp = it.next().getPath()
        name = fp.getName()
        if name.endswith(suffix) and not name.startswith(("_", ".")):
            out.append(fp.toString())
    return out
