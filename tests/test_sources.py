import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.campaigns import apply_receipts
from cohorta.operators.paging import list_contacts
from cohorta.plans.launch import launch_campaigns
from cohorta.sources.readers import conform, read_source, table_or_empty
from cohorta.sources.warehouse import Warehouse

CSV = "ID,Email,email_status\n007,a@x.test,1\n8,b@x.test,2\n"


def test_source_formats(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.csv")
    open(p, "w").write(CSV)
    df = read_source(spark, p)
    assert df.columns == ["ID", "Email", "email_status"]
    assert [r.ID for r in df.collect()] == ["007", "8"]  # all text: leading zeros kept
    t = os.path.join(tmpdir_path, "c.tsv")
    open(t, "w").write(CSV.replace(",", "\t"))
    assert read_source(spark, t).count() == 2
    g = os.path.join(tmpdir_path, "c.csv.gz")
    with gzip.open(g, "wt") as fh:
        fh.write(CSV)
    assert read_source(spark, g).count() == 2
    folder = os.path.join(tmpdir_path, "dir")
    df.write.parquet(os.path.join(folder, "a", "x"))
    df.withColumn("extra", F.lit(1)).write.parquet(os.path.join(folder, "b"))
    both = read_source(spark, folder)
    assert both.count() == 4 and "extra" in both.columns
    single = [f for f in os.listdir(os.path.join(folder, "b")) if f.endswith(".parquet")][0]
    assert read_source(spark, os.path.join(folder, "b", single)).count() >= 1
    with pytest.raises(FileNotFoundError):
        read_source(spark, os.path.join(tmpdir_path, "missing.csv"))
    open(os.path.join(tmpdir_path, "c.json"), "w").write("{}")
    with pytest.raises(ValueError, match="unsupported file type"):
        read_source(spark, os.path.join(tmpdir_path, "c.json"))


def test_missing_table_reads_empty(spark, tmpdir_path):
    df = table_or_empty(spark, os.path.join(tmpdir_path, "nope"), S.CAMPAIGN_SUB)
    assert df.count() == 0 and df.schema == S.CAMPAIGN_SUB
    wh = Warehouse(spark, os.path.join(tmpdir_path, "empty-wh"))
    assert wh.contact().count() == 0 and wh.api_logs().count() == 0


def test_list_contacts_whitelist_and_cursor(spark):
    df = spark.createDataFrame([(i, 1, f"u{i}@x", "N", None, None, None) for i in range(1, 8)],
                               "id bigint, account_id bigint, email string, first_name string, last_name string, "
                               "company string, city string")
    out = list_contacts(df, S.CONTACT.fieldNames(), limit=3, columns=["email", "bogus"])
    assert out.columns == ["account_id", "id", "email", "has_more", "next_after"]
    assert [r.id for r in out.orderBy("id").collect()] == [1, 2, 3] and out.first().has_more
    nxt = list_contacts(df, S.CONTACT.fieldNames(), limit=3, after_id=6, columns=["email"])
    assert [r.id for r in nxt.collect()] == [7] and not nxt.first().has_more
    assert [r.id for r in list_contacts(df, S.CONTACT.fieldNames(), q="5", columns=["email"]).collect()] == [5]


def test_receipt_carry_forward(spark):
    subs = spark.createDataFrame([(1, "m1", 5, "{\"a\":1}", 4, 9)],
                                 "campaign_id bigint, message_id string, contact_id bigint, attributes string, "
                                 "queue_id int, message_size int")
    r = spark.createDataFrame([("m1", 0, "", 3, "D", "ok", dt.datetime(2024, 1, 1), 1)],
                              "message_id string, campaign_id bigint, channel string, status int, code string, "
                              "reason string, received_at timestamp, seq bigint")
    reset = apply_receipts(r, subs)[0].first()
    kept = apply_receipts(r, subs, carry_forward=True)[0].first()
    assert (reset.attributes, reset.queue_id, reset.message_size) == ("{}", 1, 0)
    assert (kept.attributes, kept.queue_id, kept.message_size) == ("{\"a\":1}", 4, 9)


def test_launch_only_new(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh-launch"))
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(7, i, f"u{i}@x", "IN" if i < 3 else "SG", "upsert", t, i) for i in range(5)],
                                 "account_id bigint, id bigint, email string, country string, _op string, "
                                 "_ts timestamp, _seq bigint")
    wh.write_snapshot("contact", conform(rows, S.with_change_columns(S.CONTACT)))
    camp = spark.createDataFrame([(1, 7, "email", "s")], "id bigint, account_id bigint, channel string, segment_id string")
    tree = {"s": {"op": "eq", "field": "country", "value": "IN"}}
    assert launch_campaigns(wh, camp, tree, now=t).first().queued == 3
    assert launch_campaigns(wh, camp, tree, now=t + dt.timedelta(hours=1), only_new=True).count() == 0
    assert wh.campaign_sub(1).count() == 3
