"""Compaction ranks with one shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.plans import compaction as C
from cohorta.sources.readers import conform
from cohorta.sources.warehouse import Warehouse


def test_one_shuffle_and_a_limit_before_it(spark, tmpdir_path, monkeypatch):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    t = dt.datetime(2024, 1, 1)
    rows = spark.range(300).select((F.col("id") % 2).alias("account_id"), (F.col("id") % 9).alias("id"), F.lit("upsert").alias("_op"),
                                   F.lit(t).alias("_ts"), F.col("id").alias("_seq"))
    wh.write_delta("contact", conform(rows, S.with_change_columns(S.CONTACT)), t.date())
    wh.write_delta("contact", conform(rows.filter("_seq < 5").withColumns({"_op": F.lit("delete"), "_ts": F.lit(t + dt.timedelta(1))}),
                                      S.with_change_columns(S.CONTACT)), t.date())
    plans = []
    monkeypatch.setattr(Warehouse, "add_snapshot_rows",
                        lambda self, table, df, real=Warehouse.add_snapshot_rows: (
                            plans.append(df._jdf.queryExecution().executedPlan().toString()), real(self, table, df)))
    before = sorted(map(tuple, wh.contact().select("account_id", "id", "id").collect()))
    got = C.compact(wh, "contact")
    assert sorted(map(tuple, wh.contact().select("account_id", "id", "id").collect())) == before
    assert got["tombstones_kept"] == 5 and got["rows_written"] == len(before)
    assert plans[0].count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plans[0]
    assert plans[0].index("Exchange") < plans[0].rindex("WindowGroupLimit")


def test_tasks_stay_small_however_many_rows_there_are(spark, tmpdir_path, monkeypatch):
    from cohorta.sources import writers as W
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    t = dt.datetime(2024, 1, 1)
    rows = spark.range(0, 4000, 1, 1).select((F.col("id") % 2).alias("account_id"), (F.col("id") % 1500).alias("id"), F.lit("upsert").alias("_op"),
                                             F.lit(t).alias("_ts"), F.col("id").alias("_seq"))
    monkeypatch.setattr(W, "GROUP_ROWS", 500)
    monkeypatch.setattr(C, "TASK_ROWS", 500)
    monkeypatch.setattr(C, "LEAST_BYTES", 1)
    wh.write_delta("contact", conform(rows, S.with_change_columns(S.CONTACT)), t.date())
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    read, seen = [], []

    def watched(self, table, df, real=Warehouse.add_snapshot_rows):
        seen.extend(spark.conf.get(k) for k in keys)
        stored = wh.files("contact", "delta").groupBy(F.spark_partition_id()).count()
        read.extend(r[1] for r in stored.collect())
        real(self, table, df)

    monkeypatch.setattr(Warehouse, "add_snapshot_rows", watched)
    want = sorted(map(tuple, wh.contact().select("account_id", "id", "email").collect()))
    C.compact(wh, "contact")
    assert sorted(map(tuple, wh.contact().select("account_id", "id", "email").collect())) == want and len(want) == 1500
    assert sum(read) == 4000 and max(read) < 2000       # row groups, not a file
    assert int(seen[0]) == 8 and int(seen[2]) < 16 << 20
    assert [spark.conf.get(k) for k in keys] == before
