"""Compaction: fold deltas into the snapshot, partition by partition.

1. List the files of the touched partitions (those with deltas; all with
   ``full``).  Only these are folded in and only these are removed.
2. Merge them.  The winners, tombstones included, are added to the snapshot
   as new files in one committed job.
3. Remove the listed files, in any order.

Between the steps, and after a crash at any point, the table holds the
winners beside some of the rows they beat, which the merge folds away: no row
is lost and no deleted row comes back, because its tombstone stays.  A
tombstone goes when it is the only row left of its key, that is at the next
compaction of the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.merge import TIE, union_by_name
from cohorta.session import scratch_dir, settings
from cohorta.sources.warehouse import FILE, FILE_BYTES, TABLES, Warehouse
from cohorta.sources.writers import delete_files, observed, sorted_tasks

#: Whole rows that a task of a compaction ranks, about, and the smallest piece of a file that it reads for them.
TASK_ROWS = 150_000
LEAST_BYTES = 256 << 10


def _listed(wh: Warehouse, table: str, part_values: list[int] | None, full: bool) -> DataFrame | None:
    """Stored rows of the touched partitions with their files."""
    column = TABLES[table].spec.partition_by[0]
    delta, snapshot = wh.files(table, "delta"), wh.files(table, "snapshot")
    if delta is not None:
        delta = delta.drop("delta_date").withColumn("_delta", F.lit(True))
    if snapshot is not None:
        snapshot = snapshot.withColumn("_delta", F.lit(False))
        if not full:
            if delta is None:
                return None
            snapshot = snapshot.join(delta.select(column).distinct(), column, "left_semi")
    parts = [p for p in (snapshot, delta) if p is not None]
    if not parts:
        return None
    rows = union_by_name(*parts)
    return rows if part_values is None else rows.filter(F.col(column).isin([int(v) for v in part_values]))


def _small_tasks(wh: Warehouse, names: str, columns: int) -> dict[str, str]:
    """Settings by which a task ranks about ``TASK_ROWS`` whole rows, before and after the shuffle.

    Files of rows that are mostly NULL are small and their rows are not, so the pieces that tasks read are cut by
    the rows a byte holds in the densest file."""
    files = wh.spark.read.schema("path string, rows long, bytes long").parquet(names)
    n, densest = files.agg(F.sum("rows"), F.max(F.col("rows") / F.col("bytes"))).first()
    if not n:
        return {}
    piece = min(128 << 20, max(LEAST_BYTES, int(TASK_ROWS / densest)))
    tasks = max(int(wh.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    return {**sorted_tasks(columns), "spark.sql.files.maxPartitionBytes": str(piece), "spark.sql.shuffle.partitions": str(tasks)}


def compact(wh: Warehouse, table: str, part_values: list[int] | None = None, full: bool = False,
            remove=delete_files) -> dict:
    """Compact ``table`` (contact / campaign_sub / campaign).

    ``part_values`` restricts it to some accounts or campaigns; ``full`` also
    rewrites partitions without deltas.  Returns rows_written (live rows),
    tombstones_kept and files_removed."""
    spec = TABLES[table].spec
    rows = _listed(wh, table, part_values, full)
    if rows is None:
        return {"rows_written": 0, "tombstones_kept": 0, "files_removed": 0}
    names = scratch_dir(wh.spark, "compacted")
    rows.groupBy(F.col(FILE).alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.max(FILE_BYTES).alias("bytes")) \
        .write.mode("overwrite").parquet(names)

    order = [F.col(c).desc_nulls_last() for c in (*spec.order, TIE)]
    window = Window.partitionBy(*spec.key).orderBy(*order)
    # the two latest rows of a key (cut to these before the shuffle, however many it has) tell whether the
    # winner stands alone, in the order that they are in already
    latest = rows.withColumn("_rn", F.row_number().over(window)).filter("_rn <= 2")
    dead = F.coalesce(F.col("_op"), F.lit("upsert" if spec.null_op_is_upsert else "delete")) == "delete"
    alone = F.lead("_rn").over(window).isNull()
    out = latest.withColumn("_alone", alone).filter("_rn = 1").filter(~(F.col("_alone") & dead))
    seen = Observation(f"compact_{table}")
    out = out.observe(seen, F.count_if(~dead).alias("live"), F.count_if(dead).alias("dead"))
    with settings(wh.spark, _small_tasks(wh, names, len(rows.columns))):
        wh.add_snapshot_rows(table, out.select(*S.with_change_columns(TABLES[table].schema).fieldNames()))
    removed = remove(wh.spark.read.schema("path string").parquet(names))
    return {"rows_written": observed(seen, "live"), "tombstones_kept": observed(seen, "dead"),
            "files_removed": int(removed or 0)}
