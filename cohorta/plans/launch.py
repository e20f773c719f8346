"""Campaign jobs: save campaigns, launch them, apply delivery receipts.

``launch_campaigns`` handles any number of campaigns in one scan of their
accounts' contacts; the queued count per campaign comes from the queue it
has written, not from a second evaluation of the filter.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.audience import to_tree
from cohorta.operators.campaigns import (NOT_FOUND, RECEIPT_FIELDS, launch_queue, receipt_id, receipt_rows,
                                         rejected_receipts, resolve_receipts)
from cohorta.operators.filters import FilterCompiler
from cohorta.session import Scratch, kept, scratch_dir
from cohorta.sources.readers import conform, has_parquet
from cohorta.sources.warehouse import Warehouse, without_event
from cohorta.sources.writers import Shaped


def campaign_changes(campaigns: DataFrame, now: _dt.datetime, op: str = "upsert") -> DataFrame:
    """Campaign metadata rows as change rows (latest wins on read)."""
    rows = campaigns.withColumns({"_op": F.lit(op), "_ts": F.lit(now).cast("timestamp"),
                                  "_seq": F.col("id").cast("bigint")})
    return conform(rows, S.with_change_columns(S.CAMPAIGN))


def campaign_segments(wh: Warehouse, campaigns: DataFrame) -> list[tuple[int, str, dict]]:
    """(account, id, tree) of the saved segments that ``campaigns`` use.

    Segments are matched within the campaign's account, where their ids are
    unique; what comes to the driver is the trees that must be compiled there."""
    used = campaigns.select(F.col("account_id").cast("bigint").alias("account_id"),
                            F.col("segment_id").cast("string").alias("id")).distinct()
    rows = wh.segments().join(used, ["account_id", "id"]).select("account_id", "id", "filter_json").collect()
    catalog = S.Catalog(S.CONTACT)
    return [(int(r.account_id), r.id, to_tree(json.loads(r.filter_json), catalog)) for r in rows]


def launch_campaigns(wh: Warehouse, campaigns: DataFrame, segment_trees: dict | None = None,
                     now: _dt.datetime | None = None, only_new: bool = False) -> DataFrame:
    """Materialise the send queue of ``campaigns`` (id, account_id, channel,
    segment_id, ...) and mark them running.  Returns (campaign_id, queued).

    Segments come from the segment table unless ``segment_trees`` (id -> tree,
    for all accounts) gives them.  Only contacts of the campaigns' accounts
    are read and merged, by a semi-join below the merge.

    ``only_new`` skips contacts already queued for the campaign (otherwise a
    second launch rewrites all rows, resetting their state)."""
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    if segment_trees is None:
        segments = campaign_segments(wh, campaigns)
    else:
        segments = [(None, str(k), tree) for k, tree in segment_trees.items()]
    if not segments:
        return wh.spark.createDataFrame([], "campaign_id bigint, queued bigint")
    accounts = campaigns.select(F.col("account_id").cast("bigint").alias("account_id")).distinct()
    contacts = wh.table("contact", keys=accounts)
    comp = FilterCompiler(S.Catalog(S.CONTACT), {f.name: f.dataType for f in contacts.schema.fields})
    queue = launch_queue(contacts, campaigns, segments, comp, now)
    if only_new:
        ids = campaigns.select(F.col("id").cast("bigint").alias("campaign_id")).distinct()
        queued = wh.table("campaign_sub", keys=ids).select("campaign_id", "message_id")
        queue = queue.join(queued, ["campaign_id", "message_id"], "left_anti")
    day = now.date()
    # written once to the shared folder: the queue is stored and counted from there
    scratch = scratch_dir(wh.spark, "launch")
    queue.write.mode("overwrite").parquet(scratch)
    queue = wh.spark.read.schema(queue.schema).parquet(scratch)
    wh.write_delta("campaign_sub", queue, day)
    counts = queue.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("queued"))
    done = campaigns.join(counts, campaigns["id"] == counts["campaign_id"], "left") \
        .withColumns({"status": F.lit("running"), "launched_at": F.lit(now).cast("timestamp"),
                      "queued_cnt": F.coalesce(F.col("queued"), F.lit(0)).cast("bigint")})
    wh.write_delta("campaign", campaign_changes(done, now), day)
    settle_receipts(wh, queue)          # receipts that came before their message was launched
    return counts


# -- receipts --------------------------------------------------------------------------------------------
# What the tables hold depends on the set of receipts alone, not on how they were cut into batches, in which
# order these came or how often:
#   * a receipt is identified by all its fields; its event is written last and says that it is applied;
#   * one that names no campaign means a launched message.  Until that is launched it waits among the
#     rejects, where the launch finds it (``settle_receipts``).


def _apply(wh: Warehouse, r: DataFrame, day: _dt.date, carry_forward: bool) -> None:
    """Store what resolved receipts do.  Deltas are merge-keyed, logs and events are added only if the table lacks them,
    and events come last, so a batch that failed anywhere may run again."""
    def made(table: int):
        return lambda rows: receipt_rows(rows, carry_forward)[table]

    # a receipt is one row by now, so those of a sink are distinct; each moves with what it says, not as a stored row
    daily = r.withColumn("dt", F.to_date(F.col("received_at").cast("timestamp")))
    wh.write_delta("campaign_sub", Shaped(r.withColumn("campaign_id", F.col("_campaign")), made(0)), day)
    wh.append_new("api_logs", Shaped(daily.withColumn("_receipt", F.col("_id")), made(2)), ("_receipt",))
    wh.append_new("dlr_event", Shaped(daily.withColumn("id", F.col("_id")), made(1)), ("id",))


def _days(df: DataFrame) -> list:
    return [r[0] for r in df.select(F.to_date("received_at")).distinct().collect()]


def _last(days: list) -> _dt.date:
    return max((d for d in days if d is not None), default=_dt.date.today())


def _once(receipts: DataFrame) -> DataFrame:
    """Each receipt once, with what it says."""
    said = receipts.select(*RECEIPT_FIELDS).withColumn("_key", F.unhex(receipt_id()))
    return said.dropDuplicates(["_key"]).drop("_key")


def apply_receipt_batch(wh: Warehouse, receipts: DataFrame, carry_forward: bool = False,
                        day: _dt.date | None = None) -> DataFrame:
    """Ingest receipts: subscriber deltas, events, logs and rejects are stored;
    returns the rejects of the batch.

    The same batch may be applied again, and batches in any order."""
    with Scratch(wh.spark) as scratch:      # each step's table goes when the next one stands
        own = scratch.keep(_once(receipts), "receipts")
        days = _days(own)
        fresh = own
        if has_parquet(wh.spark, wh.path("dlr_event")):     # asked for several times below: looked up once
            fresh = scratch.keep(without_event(own, wh.days_of("dlr_event", own, days), receipt_id()), "fresh")
            scratch.drop("receipts")
        r = scratch.keep(resolve_receipts(fresh, wh.subscribers_for(fresh)), "resolved")
        scratch.drop("receipts", "fresh")
        missed = kept(wh.spark, r.filter("not _ok").select(*RECEIPT_FIELDS), "rejects")     # for the caller: stays
        rejects = rejected_receipts(missed.withColumn("_id", receipt_id()))
        wh.append_new("dlr_reject", rejects, ("id",))
        _apply(wh, r.filter("_ok"), day or _last(days), carry_forward)
    return rejects


def settle_receipts(wh: Warehouse, messages: DataFrame | None = None, carry_forward: bool = False,
                    day: _dt.date | None = None) -> None:
    """Apply waiting receipts whose message is launched by now; ``messages`` (message_id) restricts it to these."""
    if not has_parquet(wh.spark, wh.path("dlr_reject")):
        return
    waiting = _once(wh.open_rejects(messages).filter(F.col("error") == NOT_FOUND))
    with Scratch(wh.spark) as scratch:
        held = scratch.keep(waiting, "waiting")
        known = scratch.keep(resolve_receipts(held, wh.subscribers_for(held)).filter("_ok"), "settled")
        scratch.drop("waiting")
        days = _days(known)
        if days:
            _apply(wh, known, day or _last(days), carry_forward)


def save_segments(wh: Warehouse, segments: DataFrame) -> None:
    """Append saved segments (id, account_id, name, filter_json, created_at, updated_at)."""
    wh.append("segment", conform(segments, S.SEGMENT))
