"""Session settings and the shared scratch location.

The library never picks a machine-local folder on a cluster: scratch
tables live under ``spark.checkpoint.dir`` (a shared path the cluster
names).  Only when that setting is absent (local tests) do we create
one under the system temp folder and set it on the session.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # pages are top-k per group: cut each map task to offset + limit rows first
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # partitioned writes cost per file, not per byte: let AQE keep several
    # tasks for a small rebalanced output instead of one task writing every
    # partition value serially (large shuffles are unaffected)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # looked-up keys are tested one by one against the bloom filters of row groups
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # a table of thousands of days is listed by some tasks, not by one task a day
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # a union that keeps its inputs' partitioning fails where adaptive execution changes that of one of them
    # afterwards ("Can't zip RDDs with unequal numbers of partitions")
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cohorta") -> SparkSession:
    """Session for local runs and tests (UI off, UTC, dynamic overwrite)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Set the SQL confs the operators rely on (runtime-settable ones)."""
    for k, v in RECOMMENDED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on some clusters
            pass


#: For a job that writes its result: its shuffle files go when it ends.  Spark leaves them until the driver happens to
#: collect what planned them, and a query of many written steps then holds those of all steps.
SHUFFLES_END = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` for the actions of a block, then what was set before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    A folder of this machine stands in for it only where driver and executors
    are one process; on a cluster the setting must be given."""
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not cur:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="cohorta-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cur)
    return cur


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = f"{root.rstrip('/')}/cohorta/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def kept(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared scratch location (or ``path`` there) and read from there."""
    path = path or scratch_dir(spark, name)
    with settings(df.sparkSession, SHUFFLES_END):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(p, recursive)) if fs.exists(p) else False


class Scratch:
    """Tables kept (``kept``) for the steps of a block: each goes when it is dropped, all when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_dir(self.spark, name)
        return kept(self.spark, df, name, self.paths[name])

    def drop(self, *names: str) -> None:
        for name in [n for n in names if n in self.paths]:
            delete_path(self.spark, self.paths.pop(name))
