"""Lookups, inventory, days, pages and receipts: plans and results."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.audience import parse_query
from cohorta.operators.filters import FilterError
from cohorta.operators.paging import deep_page, page
from cohorta.plans.launch import apply_receipt_batch, launch_campaigns, save_segments, settle_receipts
from cohorta.schema import sftp_catalog_for
from cohorta.sources.readers import conform
from cohorta.sources.warehouse import LISTED_KEYS, Warehouse
from cohorta.sources.writers import list_files
from cohorta.streaming.streams import RECEIPT_SCHEMA
from tests.fixture_rows import lake_contacts

T = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def subs(spark, rows):
    df = spark.createDataFrame(rows, "campaign_id bigint, message_id string, contact_id bigint, recipient string, status tinyint, "
                                     "channel string, _op string, _ts timestamp, _seq bigint")
    return conform(df, S.with_change_columns(S.CAMPAIGN_SUB))


def test_lookup_skips_row_groups(spark, tmpdir_path):
    import pyarrow.parquet as pq
    path = f"{tmpdir_path}/t"
    df = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    # rows in the order of v, so that every row group spans all values of k and only a bloom filter tells them apart
    w = df.coalesce(1).write.option("parquet.block.size", 128 << 10).option("parquet.page.size", 8 << 10)
    w.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", "4000").parquet(path)
    files = list_files(spark, path)
    groups = sum(pq.ParquetFile(f.replace("file:", "")).num_row_groups for f in files)
    assert groups > 4

    def read(values):
        found = spark.read.parquet(path).filter(F.col("k").isin(values))
        assert "PushedFilters: [In(k" in plan(found) or "PushedFilters: [IsNotNull(k), EqualTo(k" in plan(found)
        found.write.format("noop").mode("overwrite").save()
        scan = found._jdf.queryExecution()
        rows = found.collect()
        node = found._jdf.queryExecution().executedPlan()
        while node.children().size() and not node.nodeName().startswith("Scan"):
            node = node.children().apply(0)
        return rows, node.metrics().apply("numOutputRows").value(), scan

    import hashlib
    key = [hashlib.md5(str(i).encode()).hexdigest() for i in (5, 41_000)]
    rows, scanned, _ = read(key)
    assert sorted(r.v for r in rows) == [5, 41_000]
    assert 0 < scanned <= 60_000 * 3 / groups               # at most the groups that hold them (and a false positive)


def test_warehouse_lookup(spark, tmpdir_path):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    wh.write_snapshot("campaign_sub", subs(spark, [(1 + i % 2, f"m{i}", i + 1, f"u{i}", 0, "email", "upsert", T, i) for i in range(900)]))
    wh.write_delta("campaign_sub", subs(spark, [(1, "m4", 5, "u4", 3, "email", "upsert", T + dt.timedelta(1), 9),
                                                (2, "m5", None, None, None, None, "delete", T + dt.timedelta(1), 9)]), T.date())
    keys = spark.createDataFrame([("m4",), ("m5",), ("none",), (None,), ("m4",)], "message_id string")
    found = wh.lookup("campaign_sub", keys)
    assert [(r.message_id, r.status) for r in found.collect()] == [("m4", 3)]
    assert "In(message_id" in plan(found)
    many = spark.range(LISTED_KEYS + 50).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"))
    assert wh.lookup("campaign_sub", many).count() == LISTED_KEYS + 49
    # rows of a file lie in the order of the message ids
    import pyarrow.parquet as pq
    for f in list_files(spark, wh.path("campaign_sub", "snapshot")):
        ids = pq.ParquetFile(f.replace("file:", "")).read().column("message_id").to_pylist()
        assert ids == sorted(ids)


def test_inventory_reads_no_rows(spark, tmpdir_path):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    assert wh.inventory().collect() == []
    rows = [(1 + i % 3, f"m{i}", i, f"u{i}", 0, "email", "upsert", T, i) for i in range(50)]
    wh.write_snapshot("campaign_sub", subs(spark, rows))
    wh.write_delta("campaign_sub", subs(spark, rows[:7]), T.date())
    wh.write_delta("campaign_sub", subs(spark, rows[:7]), T.date() + dt.timedelta(1))
    found = wh.inventory()
    got = {r.table_part: (r.files, r.partitions, r.rows, r.bytes) for r in found.collect()}
    for part, partitions, n in (("snapshot", 3, 50), ("delta", 6, 14)):
        files = list_files(spark, wh.path("campaign_sub", part))
        size = sum(os.path.getsize(f.replace("file:", "")) for f in files)
        assert got[f"campaign_sub_{part}"] == (len(files), partitions, n, size)
    for line in plan(found).splitlines():
        if "ReadSchema" in line:
            assert "content" not in line and "message_id" not in line
    assert "FileScan parquet" not in plan(found)


def test_logs_of_a_day_read_its_partitions(spark, tmpdir_path):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    day = [T + dt.timedelta(d) for d in range(4)]
    rec = [("a", 1, "", 3, "D", "r", day[0], 1), ("a", 1, "", 4, "D", "r", day[1], 2), ("b", 1, "", 3, "D", "r", day[1], 3),
           ("b", 1, "", 5, "D", "r", day[3], 4), ("c", 1, "", 3, "D", "r", day[1], 5)]
    apply_receipt_batch(wh, spark.createDataFrame(rec, RECEIPT_SCHEMA))
    logs = wh.api_logs(day[1].date())
    assert sorted((r.message_id, r.status) for r in logs.collect()) == [("a", 4), ("c", 3)]
    assert all(f"dt#" in p and ">= 2024-01-02" in p for p in plan(logs).splitlines() if "PartitionFilters" in p)
    whole = wh.api_logs().filter(F.col("dt") == day[1].date())
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, logs.collect()))


@pytest.mark.parametrize("order_dir", ["ASC", "DESC"])
@pytest.mark.parametrize("by", [(), "g"])
def test_deep_page_equals_page(spark, order_dir, by):
    df = spark.range(4000).select("id", (F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("g"),
                                  F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 400)).alias("v"))
    for offset in (0, 13, 900, 3990):
        got = deep_page(df, "v", order_dir, 25, offset, by=by, tie="id", ranges=16)
        rows = sorted((r.g if by else 0, r.page_rank, r.id, r.v) for r in got.collect() if not by or r.g is not None)
        want = page(df, "v", order_dir, 25, offset, by=by or None, tie="id").collect()
        if by:
            assert rows == sorted((r.g, r.page_rank, r.id, r.v) for r in want if r.g is not None)
        else:
            assert [(i, v) for _, _, i, v in rows] == [(r.id, r.v) for r in want]


def test_order_without_a_limit(spark):
    c = lake_contacts(spark)
    ask = {"account_id": 6, "select": ["id"], "order_by": "id"}
    up = [r.id for r in parse_query(c, ask, sftp_catalog_for(c))[0].collect()]
    down = [r.id for r in parse_query(c, {**ask, "order_dir": "desc"}, sftp_catalog_for(c))[0].collect()]
    assert up == sorted(up) and down == up[::-1] and len(up) > 1
    for limit in ({}, {"limit": 5}):
        with pytest.raises(ValueError, match="neither ASC nor DESC"):
            parse_query(c, {**ask, **limit, "order_dir": "sideways"}, sftp_catalog_for(c))
    with pytest.raises(FilterError, match="no column 'nope'"):
        parse_query(c, {**ask, "order_by": "nope"}, sftp_catalog_for(c))


def test_one_segment_id_in_two_accounts(spark, tmpdir_path):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    people = spark.createDataFrame([(a, i, f"p{a}-{i}", f"e{a}-{i}@x", i % 2) for a in (1, 2) for i in range(6)],
                                   "account_id bigint, id bigint, primary_key string, email string, email_status int")
    wh.write_snapshot("contact", conform(people.withColumns({"_op": F.lit("upsert"), "_ts": F.lit(T), "_seq": F.col("id")}),
                                         S.with_change_columns(S.CONTACT)))
    tree = '{"op": "eq", "field": "email_status", "value": %d}'
    save_segments(wh, spark.createDataFrame([("s", 1, "a", tree % 1, T, T), ("s", 2, "b", tree % 0, T, T)],
                                            "id string, account_id bigint, name string, filter_json string, created_at timestamp, "
                                            "updated_at timestamp"))
    camps = spark.createDataFrame([(10, 1, "email", "s"), (20, 2, "email", "s")], "id bigint, account_id bigint, channel string, segment_id string")
    # a receipt of a message that is launched later waits for it
    early = spark.createDataFrame([("email-10-3", 0, "", 3, "D", "r", T, 1)], RECEIPT_SCHEMA)
    assert apply_receipt_batch(wh, early).count() == 1 and wh.open_rejects().count() == 1
    counts = launch_campaigns(wh, camps, now=T - dt.timedelta(1))
    assert sorted(map(tuple, counts.collect())) == [(10, 3), (20, 3)]
    assert {(r.campaign_id, r.contact_id) for r in wh.campaign_sub().collect()} == {(10, 1), (10, 3), (10, 5), (20, 0), (20, 2), (20, 4)}
    assert wh.open_rejects().count() == 0 and wh.append_table("dlr_event").first().campaign_id == 10
    assert wh.campaign_sub(10).filter("message_id = 'email-10-3'").first().status == 3


def stored(wh):
    view = {"sub": wh.campaign_sub().select("campaign_id", "message_id", "status", "dlr_code", "recipient"), "event": wh.append_table("dlr_event"),
            "log": wh.append_table("api_logs"), "open": wh.open_rejects()}
    return {k: sorted(map(str, map(tuple, v.collect()))) for k, v in view.items()}


def test_receipts_in_any_order_and_number(spark, tmpdir_path):
    base = subs(spark, [(c, f"m{i}", i + 1, f"u{i}@x", 0, "email", "upsert", T, i) for i in range(4) for c in (3, 2)])
    at = [T + dt.timedelta(minutes=5 * i) for i in range(4)]
    rec = [(f"m{i % 5}", c, "", s, code, why, at[i % 4], i) for i in range(10) for c in (0, 2, 9)
           for s, code, why in ((3, "D", "r"), (3, "E", "r"), (3, "D", None), (4, "D", "r"))]
    rec += [("", 0, "", 3, "D", "r", at[0], 1), (None, 7, "", 3, "D", "r", at[0], 1), ("m1", None, None, 3, None, None, None, None)]
    df = spark.createDataFrame(rec, RECEIPT_SCHEMA)
    found = []
    for name, cuts in (("a", [df]), ("b", [df.filter("campaign_id = 0"), df.filter("campaign_id <> 0 or campaign_id is null"), df]),
                       ("c", [df.filter("seq % 2 = 1"), df.union(df), df.filter("coalesce(campaign_id, 0) = 0")])):
        wh = Warehouse(spark, f"{tmpdir_path}/{name}")
        wh.write_snapshot("campaign_sub", base)
        for part in cuts:
            apply_receipt_batch(wh, part.orderBy(F.rand(len(name))))
        settle_receipts(wh)
        found.append(stored(wh))
    assert found[0] == found[1] == found[2]
    known = [r for r in rec if r[0] and (r[1] or r[0] != "m4")]
    assert len(found[0]["event"]) == len(found[0]["log"]) == len(known)      # those that differ in code or reason only, too
    assert len(found[0]["open"]) == len(rec) - len(known)
