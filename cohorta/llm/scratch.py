"""Tables and files in the shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohorta.session import apply_conf, scratch_dir
from cohorta.sources.writers import observed


def ready(spark: SparkSession) -> None:
    """Session settings of the operators: those of the library, and Arrow batches
    of a bounded size, so that long texts do not pile up in a Python worker."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor never recomputes what lies before, and
    ids given by a task hold whichever attempt was committed.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored`` and the rows written, counted by the writing job itself."""
    seen = Observation(name)
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, observed(seen, "rows")


#: Rows that a task of ``tasks_for`` takes on.
ROWS_PER_TASK = 10_000
LEAST_TASKS = 12


def tasks_for(rows: int) -> int:
    """Tasks for a step over so many rows: a small step need not pay for a task per shuffle partition.

    It only ever lowers a step's tasks (``coalesce``); a large step keeps those that the session names."""
    return max(LEAST_TASKS, -(-rows // ROWS_PER_TASK))


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh shared folder for files that tasks write themselves."""
    path = scratch_dir(spark, name)
    if path.startswith("file:"):
        return "file://" + "/" + path[len("file:"):].lstrip("/")
    return path if "://" in path else "file://" + path


def file_system(uri: str):
    """(Arrow file system, path) of a URI; any store that Arrow can open."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)
