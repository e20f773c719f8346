"""Headline timings.  Prints ONE JSON line.

Builds a contact lake (Hive partitions by account_id, ZSTD Parquet) from
lineitem x orders x customer x nation x region at $BENCH_SF_DIR (one lake
row per line item), then times the reference's benchmark shapes (count all,
count one account, 3- and 9-predicate segment counts, pages, full rewrite)
and the audience operators (campaign / segment statistics, segment
evaluation, merge-on-read, launch) on it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def session() -> SparkSession:
    from cohorta.session import RECOMMENDED_CONF
    b = (SparkSession.builder.master(f"local[{CPUS}]").appName("cohorta-bench")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(max(8, CPUS * 2))))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohorta-bench-ckpt-"))
    return spark


def build_lake(spark, path):
    from cohorta.sources.writers import write_parquet
    li = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    o = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    c = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    n = spark.read.parquet(f"{SF_DIR}/nation.parquet")
    r = spark.read.parquet(f"{SF_DIR}/region.parquet")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey) \
          .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    email = F.when(k % 13 == 0, F.lit("  ")).when(k % 17 == 0, F.lit(None).cast("string")) \
             .otherwise(F.concat(F.lit("user"), (k % 5000).cast("string"), F.lit("@"), F.lower("c_mktsegment"),
                                 F.lit(".example.com")))
    lake = j.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("c_nationkey").cast("int").alias("account_id"),
        F.concat(F.lit("pk_"), k.cast("string")).alias("primary_key"),
        email.alias("email"),
        F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0")).alias("mobile"),
        (k % 7).cast("tinyint").alias("email_status"),
        (k % 6).cast("tinyint").alias("sms_status"),
        F.when(k % 20 == 0, 1).otherwise(0).cast("tinyint").alias("is_deleted"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(F.lit(1704067200) - (k % 10) * 86400).cast("int").alias("last_emailed"),
        F.col("c_name").alias("f2"),
        F.when(k % 5 == 4, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("f6"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("f7"),
        F.col("n_name").alias("f18"),
        F.col("l_shipmode").alias("f19") if "l_shipmode" in li.columns else F.col("l_returnflag").alias("f19"),
        F.col("c_mktsegment").alias("f30"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(25 + k % 46).cast("tinyint").alias("f31"),
        F.col("o_orderpriority").alias("f14"),
    )
    write_parquet(lake, path, "overwrite", partition_by=("account_id",))


def main():
    from cohorta import schema as S
    from cohorta.operators.audience import audience, campaign_report, prepare, to_tree
    from cohorta.operators.campaigns import evaluate_segments, launch_queue
    from cohorta.operators.merge import merge_latest, union_by_name
    from cohorta.operators.stats import distinct_count, scope, segment_stats
    from cohorta.plans.derived import AS_OF, block_file_df
    from cohorta.plans.q_filters import EXCLUDE, INCLUDE, SEGMENT_DEFS
    from cohorta.session import scratch_dir
    from cohorta.sources.readers import scan_lake
    from cohorta.sources.writers import write_parquet

    spark = session()
    root = scratch_dir(spark, "bench")
    t0 = time.time()
    build_lake(spark, f"{root}/lake")
    setup = time.time() - t0
    lake = scan_lake(spark, f"{root}/lake", S.SFTP_CONTACT)
    cat = S.sftp_catalog_for(lake)
    blocks = block_file_df(spark, SF_DIR)
    rows = lake.count()

    def seg3():
        return [{"op": "eq", "field": "email_status", "value": 1}, {"op": "eq", "field": "f6", "value": "ASIA"}]

    seg9 = {"op": "and", "children": seg3() + [
        {"op": "eq", "field": "f30", "value": "BUILDING"}, {"op": "gte", "field": "f31", "value": 30},
        {"op": "lte", "field": "f31", "value": 60}, {"op": "not_in", "field": "f19", "values": ["R"]},
        {"op": "contains", "field": "email", "value": "example"},
        {"op": "gt", "field": "f7", "datatype": "date", "value": "1994-01-01"},
        {"op": "neq", "field": "sms_status", "value": 2}]}
    cols10 = ["id", "account_id", "email", "mobile", "email_status", "f2", "f6", "f7", "f18", "f30"]

    queries = {
        "q_all": lambda: lake.count(),
        "q_acct": lambda: lake.filter(F.col("account_id") == 3).count(),
        "q_seg3": lambda: audience(lake, {"op": "and", "children": seg3()}, cat, account_id=3, deleted="coalesce").count(),
        "q_seg9": lambda: audience(lake, seg9, cat, account_id=3).count(),
        "q_page10": lambda: audience(lake, seg9, cat, account_id=3).select(*cols10).orderBy("id").limit(50).collect(),
        "q_page": lambda: lake.filter(F.col("account_id") == 3).select("id", "email", "f6").orderBy("id").limit(50).collect(),
        "distinct_accounts": lambda: distinct_count(lake, "account_id").collect(),
        "segment_stats": lambda: segment_stats(scope(lake), (F.col("f30") == "BUILDING") & (F.col("f31") > 40),
                                               by="account_id").collect(),
        "campaign_stats": lambda: campaign_report(lake, INCLUDE, EXCLUDE, cat, segment_defs=SEGMENT_DEFS,
                                                  blocks=blocks, by="account_id").collect(),
        "evaluate_segments": lambda: evaluate_segments(
            scope(lake), {k: prepare(lake, [], cat)[1].compile(to_tree(SEGMENT_DEFS[k], cat, SEGMENT_DEFS))
                          for k in ("101", "102", "103", "104")}).collect(),
        "merge_latest": lambda: merge_latest(union_by_name(
            lake.withColumns({"_op": F.lit("upsert"), "_ts": F.lit(AS_OF), "_seq": F.lit(0)}),
            lake.filter(F.col("email_status") == 3).withColumns(
                {"_op": F.when(F.col("f31") > 60, "delete").otherwise("upsert"), "_ts": F.lit(AS_OF) + F.expr("INTERVAL 1 DAY"),
                 "_seq": F.lit(1)})), ("account_id", "id")).count(),
        "launch_queue": lambda: launch_queue(
            lake, spark.createDataFrame([(100 + a, a, "email" if a % 2 == 0 else "sms", "101" if a % 3 else "104")
                                         for a in range(25)], "id bigint, account_id bigint, channel string, segment_id string"),
            {k: to_tree(SEGMENT_DEFS[k], cat, SEGMENT_DEFS) for k in ("101", "104")}, prepare(lake, [], cat)[1], AS_OF).count(),
        "q_star": lambda: write_parquet(spark.read.parquet(f"{root}/lake"), f"{root}/star-{time.time_ns()}", "overwrite"),
    }
    # write-side jobs, each run once on fresh folders
    import datetime as dt

    from cohorta.plans.compaction import compact
    from cohorta.plans.derived import campaign_sub_df, receipts_df
    from cohorta.plans.importer import import_contacts
    from cohorta.plans.launch import apply_receipt_batch
    from cohorta.plans.q_jobs import raw_contacts_df
    from cohorta.sources.readers import conform
    from cohorta.sources.warehouse import Warehouse
    wh = Warehouse(spark, f"{root}/wh")
    raw_contacts_df(spark, SF_DIR).write.option("header", True).option("escape", '"').csv(f"{root}/raw.csv")
    wh.write_snapshot("campaign_sub", conform(campaign_sub_df(spark, SF_DIR), S.with_change_columns(S.CAMPAIGN_SUB)))
    month = receipts_df(spark, SF_DIR).filter("received_at >= '1996-03-01' and received_at < '1996-04-01'")
    once = {
        "import_contacts": lambda: import_contacts(wh, f"{root}/raw.csv", 7, mode="snapshot", now=AS_OF),
        "apply_receipts_month": lambda: apply_receipt_batch(wh, month, day=dt.date(1996, 4, 1)),
        "compact_campaign_sub": lambda: compact(wh, "campaign_sub"),
    }
    times = {}
    for name, fn in once.items():
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
    for name, fn in queries.items():
        fn()  # warm-up (JIT, file listing cache)
        best = None
        for _ in range(3):
            t = time.time()
            fn()
            d = time.time() - t
            best = d if best is None else min(best, d)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "lake_rows": rows,
                      "setup_sec": round(setup, 3), "cpus": CPUS}))


if __name__ == "__main__":
    main()
