"""Smoke sequence (FIXTURES.md §1) and compaction invariants."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.filters import compile_filter
from cohorta.operators.merge import merge_with_spec
from cohorta.operators.stats import preview, status_breakdown
from cohorta.plans.compaction import compact
from cohorta.plans.importer import import_contacts, import_subscribers
from cohorta.plans.launch import apply_receipt_batch, launch_campaigns, save_segments
from cohorta.sources.readers import conform
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import delete_files, list_files

CSV = """id,email,mobile,first_name,last_name,city,country,company,lifecycle_stage,loyalty_tier,email_status,sms_status
11,ann@mail.test,+4711,Ann,Berg,Oslo,NO,Alder,lead,one,1,1
12,bo@mail.test,+4712,"Bo ""B"", jr",Dahl,Bergen,NO,Birch,customer,two,1,0
13,cy@mail.test,+4713,Cy,Egge,Turku,FI,Cedar,customer,one,2,1
14,di@mail.test,,Di,Foss,Lund,SE,,lead,,1,1
x,eve@mail.test,,Eve,Gran,Oslo,NO,,lead,,1,1
"""


def test_smoke_sequence(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "contacts_sample.csv")
    with open(src, "w") as fh:
        fh.write(CSV)
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh"))
    now = dt.datetime(2024, 3, 1, 12, 0, 0)
    assert import_contacts(wh, src, 42, mode="snapshot", now=now) == {
        "table": "contact", "rows": 4, "mode": "snapshot", "source": src, "rejected": 1}
    contacts = wh.contact(42)
    assert contacts.count() == 4 and wh.append_table("import_reject").count() == 1
    assert contacts.filter("id = 12").first().first_name == 'Bo "B", jr'
    row = contacts.filter("id = 11").first()
    assert (row.account_id, row.primary_key, row.domain, row.is_deleted, row.is_contact, row.import_source) == \
        (42, "ann@mail.test", "mail.test", 0, 1, 1)
    tree = {"op": "eq", "field": "country", "value": "NO"}
    matched = contacts.filter(compile_filter(tree, S.Catalog(S.CONTACT), contacts))
    counts, sample = preview(matched, n=20)
    assert counts.first().cnt == 2 and sample.count() == 2
    save_segments(wh, spark.createDataFrame([("s1", 42, "Norway", json.dumps(tree), now, now)],
                                            "id string, account_id bigint, name string, filter_json string, "
                                            "created_at timestamp, updated_at timestamp"))
    seg = wh.append_table("segment").first()
    camp = spark.createDataFrame([(1, 42, "launch", "email", seg.id, "draft", now)],
                                 "id bigint, account_id bigint, name string, channel string, segment_id string, "
                                 "status string, created_at timestamp")
    queued = launch_campaigns(wh, camp, now=now)
    assert [tuple(r) for r in queued.collect()] == [(1, 2)]
    subs = wh.campaign_sub(1)
    assert subs.count() == 2
    first = subs.orderBy("contact_id").first()
    assert first.message_id == "email-1-11" and first.recipient == "ann@mail.test" and first.status == 0
    c = wh.campaign(42).first()
    assert (c.status, c.queued_cnt) == ("running", 2)
    receipts = spark.createDataFrame([(first.message_id, 0, "", 3, "DELIVRD", "ok", now + dt.timedelta(minutes=5), 1)],
                                     "message_id string, campaign_id bigint, channel string, status int, code string, "
                                     "reason string, received_at timestamp, seq bigint")
    assert apply_receipt_batch(wh, receipts).count() == 0
    assert wh.campaign_sub(1).filter(F.col("message_id") == first.message_id).first().status == 3
    assert wh.api_logs().count() == 1
    assert {(r.status, r.cnt) for r in status_breakdown(wh.campaign_sub(1)).collect()} == {(0, 1), (3, 1)}
    res = compact(wh, "contact")
    assert res["rows_written"] == 0                      # nothing to fold: no delta
    assert compact(wh, "contact", full=True)["rows_written"] == 4
    assert wh.contact(42).count() == 4
    assert len(list_files(spark, wh.path("contact", "snapshot"))) >= 1
    assert len(list_files(spark, wh.path("api_logs"))) == 1


def _changes(spark, rows):
    df = spark.createDataFrame(rows, "account_id bigint, id bigint, email string, _op string, _ts timestamp, _seq bigint")
    return conform(df, S.with_change_columns(S.CONTACT))


def test_compaction_invariants(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh2"))
    t = dt.datetime(2024, 1, 1)
    h = lambda n: t + dt.timedelta(hours=n)
    wh.write_snapshot("contact", _changes(spark, [(1, i, f"s{i}", "upsert", h(0), i) for i in range(10)]
                                          + [(2, 1, "acct2", "upsert", h(0), 1)]))
    wh.write_delta("contact", _changes(spark, [(1, 1, "new", "upsert", h(1), 1), (1, 2, None, "delete", h(1), 2),
                                               (1, 20, "added", "upsert", h(2), 20)]), t.date())
    wh.write_delta("contact", _changes(spark, [(2, 1, None, "delete", h(3), 1)]), (t + dt.timedelta(days=1)).date())
    before = sorted(tuple(r) for r in wh.contact().select("account_id", "id", "email").collect())
    res = compact(wh, "contact")
    read = lambda: sorted(tuple(r) for r in wh.contact().select("account_id", "id", "email").collect())
    after = read()
    assert before == after and len(after) == 10
    assert res["files_removed"] >= 4 and list_files(spark, wh.path("contact", "delta")) == []
    # account 2 is wholly deleted: its tombstone stays until the next compaction, its old row is gone
    assert res["tombstones_kept"] == 2 and wh.contact(2).count() == 0
    assert compact(wh, "contact")["files_removed"] == 0            # no delta, nothing to do
    assert compact(wh, "contact", full=True)["tombstones_kept"] == 0
    assert read() == after and wh.changes("contact").count() == 10


@pytest.mark.parametrize("newest_first", [True, False])
def test_interrupted_compaction_brings_nothing_back(spark, tmpdir_path, newest_first):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh4"))
    t = dt.datetime(2024, 1, 1)
    for day, rows in enumerate([[(1, 1, "old", "upsert", t, 1), (1, 2, "b", "upsert", t, 1)],
                                [(1, 1, "newer", "upsert", t + dt.timedelta(days=1), 2)],
                                [(1, 1, None, "delete", t + dt.timedelta(days=2), 3)]]):
        wh.write_delta("contact", _changes(spark, rows), (t + dt.timedelta(days=day)).date())

    def first_only(files):
        names = sorted((r.path for r in files.collect()), reverse=newest_first)
        delete_files(spark.createDataFrame([(names[0],)], "path string"))
        raise OSError("lost")

    with pytest.raises(OSError):
        compact(wh, "contact", remove=first_only)
    for _ in range(3):
        assert [r.id for r in wh.contact(1).collect()] == [2]
        compact(wh, "contact", full=True)
    assert wh.changes("contact").count() == 1


def test_snapshot_import_replaces_its_partition_only(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh5"))

    def write(name, text):
        path = os.path.join(tmpdir_path, name)
        with open(path, "w") as fh:
            fh.write(text)
        return path

    import_subscribers(wh, write("a.csv", "contact_id,message_id\n1,m1\n2,m2\n"), 3, mode="snapshot")
    got = import_subscribers(wh, write("b.csv", "campaign_id,contact_id,message_id\n9,5,n1\n3,6,stray\n,7,n2\nx,8,n3\n"),
                             9, mode="snapshot")
    assert got["rows"] == 3 and got["rejected"] == 1
    assert {r.message_id for r in wh.campaign_sub(3).collect()} == {"m1", "m2"}
    assert {r.message_id for r in wh.campaign_sub(9).collect()} == {"n1", "n2", "n3"}
    # an empty file empties its own partition
    assert import_subscribers(wh, write("c.csv", "contact_id,message_id\nbad,q\n"), 3, mode="snapshot")["rows"] == 0
    assert wh.campaign_sub(3).count() == 0 and wh.campaign_sub(9).count() == 3


def test_merged_read_prunes_columns(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh6"))
    wh.write_snapshot("contact", _changes(spark, [(1, 1, "x", "upsert", dt.datetime(2024, 1, 1), 1)]))
    plan = wh.contact(1).select("id")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "ReadSchema" in line:
            assert "email" not in line and "_tie" in line


def test_segments_latest_version_and_owner(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh7"))
    t = dt.datetime(2024, 1, 1)
    cols = "id string, account_id bigint, name string, filter_json string, created_at timestamp, updated_at timestamp"
    save_segments(wh, spark.createDataFrame([("s", 1, "old", "{}", t, t), ("s", 1, "new", "{}", t, t + dt.timedelta(1)),
                                             ("s", 2, "other", "{}", t, t)], cols))
    assert {(r.account_id, r.name) for r in wh.segments().collect()} == {(1, "new"), (2, "other")}
    assert wh.segments(2).first().name == "other"


def test_partition_pruning_in_plan(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh3"))
    t = dt.datetime(2024, 1, 1)
    wh.write_snapshot("contact", _changes(spark, [(a, i, "x", "upsert", t, i) for a in (1, 2, 3) for i in range(3)]))
    plan = wh.contact(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "account_id" in plan
    assert wh.contact(2).count() == 3
