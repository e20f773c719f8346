"""Streams equal the batch result; replays, repeats and late rows are neither lost nor doubled."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.campaigns import apply_receipts
from cohorta.operators.merge import merge_latest
from cohorta.sources.readers import conform
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import write_parquet
from cohorta.streaming.streams import RECEIPT_SCHEMA, run_activity_stream, run_dedup_stream, run_receipt_stream

T = dt.datetime(2024, 1, 1)


def _subs(spark):
    rows = [(1, f"email-1-{i}", i, f"u{i}@x.test", 0, "email", "upsert", T, i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "campaign_id bigint, message_id string, contact_id bigint, recipient string, "
                                     "status tinyint, channel string, _op string, _ts timestamp, _seq bigint")
    return conform(df, S.with_change_columns(S.CAMPAIGN_SUB))


def _receipts(spark):
    rows = [(f"email-1-{i}", 0, "", 3 + (i % 2), "D", "r", T + dt.timedelta(minutes=i), i) for i in range(1, 6)]
    rows.append(("sms-9-1", 9, "sms", 5, "X", "orphan", T, 99))
    rows.append(("sms-0-1", 0, "", 5, "X", "unknown", T, 100))
    rows.append((None, 0, "", 5, "X", "no id", T, 101))
    return spark.createDataFrame(rows, RECEIPT_SCHEMA)


def _stored(spark, root):
    write_parquet(_receipts(spark).repartition(2), f"{root}/in", "overwrite")
    wh = Warehouse(spark, f"{root}/wh")
    wh.write_snapshot("campaign_sub", _subs(spark))
    return wh


def _check(wh):
    spark = wh.spark
    got = sorted(tuple(r) for r in wh.campaign_sub().select("message_id", "status").collect())
    sub_delta, _, _, rejects = apply_receipts(_receipts(spark), merge_latest(_subs(spark), ("campaign_id", "message_id")))
    batch = merge_latest(_subs(spark).unionByName(conform(sub_delta, S.with_change_columns(S.CAMPAIGN_SUB))),
                         ("campaign_id", "message_id"))
    assert got == sorted(tuple(r) for r in batch.select("message_id", "status").collect())
    assert ("sms-9-1", 5) in got and all(m != "sms-0-1" for m, _ in got)
    assert rejects.count() == 2
    assert wh.append_table("dlr_event").count() == 6
    assert wh.api_logs().count() == 6
    assert sorted(r.error for r in wh.append_table("dlr_reject").collect()) == ["message_id not found", "no message_id"]


def test_receipt_stream_equals_batch_and_replay_is_idempotent(spark, tmpdir_path):
    wh = _stored(spark, tmpdir_path)
    run_receipt_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/ckpt")
    run_receipt_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/ckpt")     # nothing new
    _check(wh)
    run_receipt_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/other")    # progress lost: all again
    _check(wh)


def test_failure_between_the_sinks(spark, tmpdir_path, monkeypatch):
    wh = _stored(spark, tmpdir_path)
    real, calls = Warehouse.append_new, []

    def failing(self, table, df, keys):
        real(self, table, df, keys)
        calls.append(table)
        if len(calls) == 2:                        # events and logs are written, rejects are not
            raise OSError("lost")

    monkeypatch.setattr(Warehouse, "append_new", failing)
    with pytest.raises(Exception):
        run_receipt_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/ckpt")
    run_receipt_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/ckpt")
    _check(wh)


def test_repeats_and_late_receipts(spark, tmpdir_path):
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    r = _receipts(spark)
    late = r.withColumn("received_at", F.col("received_at") - F.expr("interval 400 days"))
    for part in (r, r, late, late.union(r)):
        write_parquet(part, f"{tmpdir_path}/in", "append")
        run_dedup_stream(spark, wh, f"{tmpdir_path}/in", f"{tmpdir_path}/ckpt")
    out = wh.append_table("receipt")
    assert out.count() == 2 * r.count() == out.distinct().count()


def test_activity_replay(spark, tmpdir_path):
    raw = spark.createDataFrame([("1", "5", "2"), ("2", "6", "1"), ("x", "7", "1")], "id string, contact_id string, action string")
    write_parquet(raw, f"{tmpdir_path}/in", "overwrite")
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    for k in range(2):
        run_activity_stream(spark, wh, f"{tmpdir_path}/in", raw.schema, f"{tmpdir_path}/c{k}", "2024-02-01", T)
    assert sorted(r.id for r in wh.append_table("campaign_activity").collect()) == [1, 2]


def test_one_message_id_in_two_campaigns(spark):
    subs = _subs(spark)
    both = subs.unionByName(subs.withColumns({"campaign_id": F.lit(2).cast("bigint"), "recipient": F.lit("other@x.test")}))
    rec = spark.createDataFrame([("email-1-1", 2, "", 3, "D", "r", T, 1), ("email-1-1", 0, "", 4, "D", "r", T, 2),
                                 ("email-1-1", 7, "", 5, "D", "r", T, 3), ("", 0, "", 5, "D", "r", T, 4)], RECEIPT_SCHEMA)
    delta, _, _, rejects = apply_receipts(rec, merge_latest(both, ("campaign_id", "message_id")))
    assert sorted((r._seq, r.campaign_id, r.recipient) for r in delta.collect()) == [
        (1, 2, "other@x.test"), (2, 1, "u1@x.test"), (3, 7, "")]
    assert [r.seq for r in rejects.collect()] == [4]


def test_unions_do_not_take_over_the_partitioning_of_their_inputs(spark):
    """Adaptive execution may change one input afterwards; the union then failed with unequal numbers of partitions."""
    from cohorta.session import apply_conf
    apply_conf(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_message_ids_in_two_campaigns_and_receipts_without_one(spark):
    from cohorta.operators.campaigns import resolve_receipts
    subs = spark.createDataFrame([(2, "m", 5, "second"), (1, "m", 5, "first"), (0, "m", 0, "by receipt"), (None, "m", 5, "none")],
                                 "campaign_id bigint, message_id string, contact_id bigint, recipient string")
    rec = spark.createDataFrame([("m", 0), ("m", None), ("m", 2), ("m", 9), ("x", 0), (None, 0), ("", 2)],
                                "message_id string, campaign_id bigint")
    for name, kind in (("channel", "string"), ("status", "int"), ("code", "string"), ("reason", "string"),
                       ("received_at", "timestamp"), ("seq", "bigint")):
        rec = rec.withColumn(name, F.lit(None).cast(kind))
    got = [(r.message_id, r.campaign_id, r.s_recipient, r._ok) for r in resolve_receipts(rec, subs).collect()]
    assert sorted(got, key=str) == sorted([("m", 0, "first", True), ("m", None, "first", True), ("m", 2, "second", True),
                                           ("m", 9, None, True), ("x", 0, None, False), (None, 0, None, False),
                                           ("", 2, None, False)], key=str)


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def test_a_batch_leaves_neither_its_steps_nor_its_shuffles(spark, tmpdir_path):
    """Only the rejects that the caller gets stay in the shared folder; no shuffle file outlasts the step that made it."""
    import os

    from cohorta.plans.launch import apply_receipt_batch, settle_receipts
    from cohorta.session import checkpoint_root
    wh = _stored(spark, tmpdir_path)
    shared = os.path.join(checkpoint_root(spark).replace("file:", ""), "cohorta")
    kept, shuffles = set(os.listdir(shared)) if os.path.isdir(shared) else set(), _shuffle_files(spark)
    receipts = _receipts(spark).repartition(3).union(_receipts(spark))
    first = apply_receipt_batch(wh, receipts)
    again = apply_receipt_batch(wh, receipts)
    settle_receipts(wh)
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(shared)) - kept} == {"rejects"}
    deadline = time.time() + 20         # Spark removes them in the background
    while _shuffle_files(spark) - shuffles and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - shuffles
    assert sorted(r.seq for r in first.collect()) == sorted(r.seq for r in again.collect()) == [100, 101]
    _check(wh)


def test_receipts_move_without_what_follows_from_them(spark, tmpdir_path, monkeypatch):
    """A sink's constants and derived columns are made where its rows have arrived."""
    from cohorta.plans import launch
    from cohorta.sources import warehouse
    wh, real, moved = _stored(spark, tmpdir_path), warehouse.write_parquet, {}

    def seen(df, path, *a, shape=None, **k):
        moved[path.split("/wh/")[1].split("/")[0]] = (set(df.columns), shape and set(shape(df).columns))
        return real(df, path, *a, shape=shape, **k)

    monkeypatch.setattr(warehouse, "write_parquet", seen)
    launch.apply_receipt_batch(wh, _receipts(spark))
    for table, made in (("campaign_sub", "soft_bounce_retry"), ("api_logs", "sent_ip"), ("dlr_event", "created_at")):
        assert made not in moved[table][0] and made in moved[table][1]
    monkeypatch.undo()
    _check(wh)


def test_waiting_receipts_stored_twice_are_applied_once(spark, tmpdir_path):
    from cohorta.plans.launch import apply_receipt_batch, settle_receipts
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    apply_receipt_batch(wh, _receipts(spark))
    wh.append("dlr_reject", wh.append_table("dlr_reject"))
    wh.write_snapshot("campaign_sub", _subs(spark))
    settle_receipts(wh)
    assert wh.append_table("dlr_event").count() == 6 and wh.append_table("api_logs").count() == 6


def test_receipts_before_their_launch_leave_no_steps(spark, tmpdir_path):
    import os

    from cohorta.plans.launch import apply_receipt_batch, settle_receipts
    from cohorta.session import checkpoint_root
    wh = Warehouse(spark, f"{tmpdir_path}/wh")
    shared = os.path.join(checkpoint_root(spark).replace("file:", ""), "cohorta")
    os.makedirs(shared, exist_ok=True)
    kept = set(os.listdir(shared))
    early = _receipts(spark).filter("campaign_id = 0")
    assert apply_receipt_batch(wh, early).count() == 7
    wh.write_snapshot("campaign_sub", _subs(spark))
    settle_receipts(wh, _subs(spark))
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(shared)) - kept} == {"rejects"}
    apply_receipt_batch(wh, _receipts(spark))
    _check_applied(wh)


def _check_applied(wh):
    assert wh.append_table("dlr_event").count() == wh.api_logs().count() == 6
    assert sorted(r.seq for r in wh.open_rejects().collect()) == [100, 101]


def test_stream_inputs_are_cut_by_size(spark, tmpdir_path, monkeypatch):
    """No fixed number of tasks writes the input of a stream, whatever its size."""
    import inspect

    from cohorta.plans import q_jobs, q_more
    for query in (q_jobs.q_stream_receipts, q_jobs.q_stream_dedup, q_jobs.q_stream_activity, q_more.q_stream_late,
                  q_more.q_stream_replay, q_more.q_import_parquet):
        assert ".repartition(" not in inspect.getsource(query)
