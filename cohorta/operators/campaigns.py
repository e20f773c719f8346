"""Campaign operators: segment evaluation, launch queue, delivery receipts.

All are set-based: many segments, campaigns or receipts per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.filters import FilterCompiler, balanced
from cohorta.operators.segments import books, segment_members

#: So many segments stand in one projection; more are evaluated as bit programs (``operators.segments``).
FEW_SEGMENTS = 64


def _owned(condition: Column, owner, account: str = "account_id") -> Column:
    """A segment's predicate, false outside the account it belongs to."""
    return condition if owner is None else (F.col(account) == F.lit(owner)) & condition


def evaluate_segments(df: DataFrame, compiled: dict[str, Column], by=("account_id",),
                      owners: dict[str, int] | None = None) -> DataFrame:
    """Count every saved segment in one scan -> (by..., segment_id, cnt).

    One conditional count per segment is a single partial/final aggregate;
    the wide row (one per group) is then turned into one row per segment.
    For tens of segments; ``segments.count_segments`` takes any number.
    ``owners`` (segment -> account) keeps each segment to its own account."""
    by, owners = list(by), owners or {}
    ids = list(compiled)
    wide = df.groupBy(*by).agg(*[F.count_if(_owned(compiled[s], owners.get(s))).alias(f"_s{i}")
                                 for i, s in enumerate(ids)])
    pairs = F.array(*[F.struct(F.lit(s).alias("segment_id"), F.col(f"_s{i}").alias("cnt"),
                               F.lit(owners.get(s)).cast("bigint").alias("_owner"))
                      for i, s in enumerate(ids)])
    out = wide.select(*by, F.inline(pairs))
    if owners:
        out = out.filter(F.col("_owner").isNull() | (F.col("_owner") == F.col("account_id")))
    return out.drop("_owner")


def segment_membership(df: DataFrame, compiled: dict[str, Column], keep=("account_id", "id"),
                       owners: dict[str, int] | None = None) -> DataFrame:
    """One row per (contact, matching segment): explode of the ids whose
    predicate is TRUE (rows matching nothing produce no output)."""
    owners = owners or {}
    hits = F.array_compact(F.array(*[F.when(_owned(c, owners.get(s)), F.lit(s)) for s, c in compiled.items()]))
    return df.select(*keep, F.explode(hits).alias("segment_id"))


def queue_rows(audience: DataFrame, campaign_id: Column, channel: Column, now) -> DataFrame:
    """Send-queue rows (campaign_sub layout + change columns) for an audience
    frame that carries contact columns plus campaign id and channel."""
    recipient = F.when(channel == F.lit("sms"), F.col("mobile")).otherwise(F.col("email"))
    return audience.select(
        campaign_id.cast("bigint").alias("campaign_id"),
        F.coalesce(F.col("primary_key"), F.col("email"), F.col("id").cast("string")).alias("primary_key"),
        F.lit(1).cast("bigint").alias("version_id"),
        F.col("id").cast("bigint").alias("contact_id"),
        recipient.cast("string").alias("recipient"),
        F.lit("{}").alias("attributes"),
        F.lit(0).cast("int").alias("message_size"),
        F.lit(None).cast("timestamp").alias("sent_on"),
        F.lit(0).cast("tinyint").alias("priority"),
        F.lit(1).cast("int").alias("queue_id"),
        F.lit(0).cast("int").alias("connection_id"),
        F.lit(0).cast("tinyint").alias("status"),
        F.lit(0).cast("tinyint").alias("total_open"),
        F.lit(0).cast("tinyint").alias("total_click"),
        F.lit(None).cast("string").alias("drop_reason"),
        F.lit(1).cast("tinyint").alias("soft_bounce_retry"),
        F.lit(0).cast("tinyint").alias("total_open_amp"),
        F.lit(0).cast("tinyint").alias("total_click_amp"),
        F.format_string("%s-%d-%d", channel, campaign_id.cast("bigint"), F.col("id").cast("bigint")).alias("message_id"),
        channel.cast("string").alias("channel"),
        F.lit(None).cast("string").alias("dlr_code"),
        F.lit(None).cast("timestamp").alias("dlr_at"),
        F.lit("upsert").alias("_op"),
        F.lit(now).cast("timestamp").alias("_ts"),
        F.col("id").cast("bigint").alias("_seq"),
    )


def launch_queue(contacts: DataFrame, campaigns: DataFrame, segment_trees, compiler: FilterCompiler,
                 now, deleted_coalesce: bool = True) -> DataFrame:
    """Queue rows for many campaigns in one scan of the contacts.

    ``campaigns``: (id, account_id, channel, segment_id).  ``segment_trees``:
    id -> tree for all accounts, or (account, id, tree) rows, each for its own
    account.  Contacts are tagged with the segments of their account that hold
    them, then joined to the campaigns on (account_id, segment_id); Spark picks
    the join by the measured size of the campaigns."""
    c = contacts
    if deleted_coalesce:
        c = c.filter(F.coalesce(F.col("is_deleted"), F.lit(0)) == 0)
    segments = [(None, str(k), t) for k, t in segment_trees.items()] if isinstance(segment_trees, dict) else segment_trees
    members = segments_of(c, segments, compiler, ["account_id", "id", "primary_key", "email", "mobile"])
    camp = campaigns.select(F.col("id").alias("_campaign_id"), F.col("account_id").cast(members.schema["account_id"].dataType).alias("account_id"),
                            F.col("channel").alias("_channel"), F.col("segment_id").cast("string").alias("segment_id"))
    joined = members.join(camp, ["account_id", "segment_id"])
    return queue_rows(joined, F.col("_campaign_id"), F.col("_channel"), now)


def segments_of(df: DataFrame, segments, compiler: FilterCompiler, keep) -> DataFrame:
    """``keep`` and segment_id for every (account or None, id, tree) that holds a row: a few as expressions of one
    projection, more as bit programs.  Both give the same rows."""
    if len(segments) > FEW_SEGMENTS:
        return segment_members(df, books(segments, compiler), keep)
    # ids of two accounts may be equal: columns go by number, ids are put in afterwards
    compiled = {str(i): compiler.compile(tree) for i, (_, _, tree) in enumerate(segments)}
    found = segment_membership(df, compiled, keep, owners={str(i): owner for i, (owner, _, _) in enumerate(segments)})
    names = F.array(*[F.lit(name) for _, name, _ in segments])
    return found.withColumn("segment_id", F.get(names, F.col("segment_id").cast("int")))


#: What a receipt says; together these are its identity.
RECEIPT_FIELDS = ("message_id", "campaign_id", "channel", "status", "code", "reason", "received_at", "seq")
NO_ID, NOT_FOUND = "no message_id", "message_id not found"


def receipt_id() -> Column:
    """Identity of a receipt: a hash of all that it says, as it was delivered.

    Receipts that differ in any field are different ones; the same receipt
    delivered twice is one."""
    said = F.struct(*[F.col(c).cast("string").alias(c) for c in RECEIPT_FIELDS])
    return F.sha2(F.to_json(said), 256).substr(1, 32)


def has_message() -> Column:
    return F.coalesce(F.col("message_id"), F.lit("")) != ""


def is_unnamed() -> Column:
    """The receipt does not say which campaign its message belongs to."""
    return F.coalesce(F.col("campaign_id"), F.lit(0)) == 0


def match_receipts(receipts: DataFrame, sub: DataFrame) -> DataFrame:
    """Each receipt once, with the subscriber row (``s_`` columns) it means, if any.

    A receipt that names its campaign means the row of that campaign.  One that
    names none means the row of its message id in the lowest campaign that
    launched it (``s_launched``); rows that other receipts made do not count, so
    its meaning does not depend on the order in which receipts come.  Receipts
    without a message id match nothing and take no part in the join."""
    cols = [c for c in sub.columns if c != "message_id"]
    # one join by message id alone: subscribers that lie by message id already are not moved again
    first = F.row_number().over(Window.partitionBy("message_id").orderBy(
        F.col("s_launched").desc_nulls_last(), F.col("s_campaign_id").asc_nulls_last()))
    r = receipts.filter(has_message()).alias("r")
    s = sub.withColumn("_first", (first == 1) & F.col("s_launched") & F.col("s_campaign_id").isNotNull()).alias("s")
    meant = F.when(F.coalesce(F.col("r.campaign_id"), F.lit(0)) == 0, F.col("s._first")) \
             .otherwise(F.col("r.campaign_id") == F.col("s.s_campaign_id"))
    found = r.join(s, (F.col("r.message_id") == F.col("s.message_id")) & meant, "left").select(
        *[F.col(f"r.{c}") for c in receipts.columns], *[F.col(f"s.{c}") for c in cols])
    neither = receipts.filter(~has_message()).select("*", *[F.lit(None).cast(sub.schema[c].dataType).alias(c) for c in cols])
    return found.unionByName(neither)


def resolve_receipts(receipts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Receipts with what they mean: ``_id``, ``_campaign``, ``_channel``, ``_recipient``, the subscriber's ``s_``
    columns, and ``_ok`` if it can be applied.

    Subscribers with a contact or a primary key were launched; those with neither stem from receipts."""
    have = set(subscribers.columns)
    carried = ("campaign_id", "channel", "recipient", "primary_key", "version_id", "contact_id", "attributes",
               "queue_id", "message_size", "drop_reason", "total_open", "total_click")
    signs = [F.coalesce(F.col(c).cast("string"), F.lit(none)) != none for c, none in (("contact_id", "0"), ("primary_key", ""))
             if c in have]
    launched = balanced(lambda a, b: a | b, signs) if signs else F.lit(True)
    sub = subscribers.select("message_id", launched.alias("s_launched"), *[
        (F.col(c) if c in have else F.lit(None)).alias(f"s_{c}") for c in carried])
    r = match_receipts(receipts.withColumn("_id", receipt_id()), sub)
    given_campaign = F.when(~is_unnamed(), F.col("campaign_id"))
    return r.withColumns({
        "_campaign": F.coalesce(given_campaign, F.col("s_campaign_id")).cast("bigint"),
        "_channel": F.coalesce(F.when(F.col("channel") != "", F.col("channel")), F.col("s_channel"),
                               F.coalesce(F.col("channel"), F.lit(""))),
        "_recipient": F.coalesce(F.col("s_recipient"), F.lit("")),
        "_ok": (F.col("s_campaign_id").isNotNull() | given_campaign.isNotNull()) & has_message(),
    })


def rejected_receipts(r: DataFrame) -> DataFrame:
    """Reject rows of resolved receipts: the whole receipt and why it is not applied."""
    return r.select(
        F.col("_id").alias("id"), "message_id", F.col("campaign_id").cast("bigint").alias("campaign_id"), "channel",
        F.col("status").cast("int").alias("status"), F.col("code").cast("string").alias("code"),
        F.col("reason").cast("string").alias("reason"), F.col("received_at").cast("timestamp").alias("received_at"),
        F.col("seq").cast("bigint").alias("seq"), F.when(has_message(), NOT_FOUND).otherwise(NO_ID).alias("error"),
        F.to_date(F.col("received_at").cast("timestamp")).alias("dt"))


def apply_receipts(receipts: DataFrame, subscribers: DataFrame, carry_forward: bool = False,
                   materialize=None):
    """Delivery receipts -> (subscriber deltas, dlr events, api-log rows, rejects).

    ``receipts``: message_id, campaign_id (0/NULL = unknown), channel (''/NULL
    = unknown), status, code, reason, received_at, seq.  Looked up against
    the merged subscriber table by ``match_receipts``.  ``materialize``
    (e.g. ``lambda d: d.checkpoint()``) is applied to the joined frame so a
    job writing all four outputs runs the lookup join once."""
    r = resolve_receipts(receipts, subscribers)
    if materialize is not None:
        r = materialize(r)
    return *receipt_rows(r.filter(F.col("_ok")), carry_forward), rejected_receipts(r.filter(~F.col("_ok")))


def receipt_rows(ok: DataFrame, carry_forward: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subscriber deltas, dlr events, api-log rows) of resolved receipts that can be applied."""
    ts = F.col("received_at").cast("timestamp")
    keep = (lambda c, d: F.coalesce(F.col(c), d)) if carry_forward else (lambda c, d: d)
    sub_delta = ok.select(
        F.col("_campaign").alias("campaign_id"),
        F.coalesce(F.col("s_primary_key"), F.col("_recipient")).alias("primary_key"),
        F.coalesce(F.col("s_version_id"), F.lit(1).cast("bigint")).alias("version_id"),
        F.coalesce(F.col("s_contact_id"), F.lit(0).cast("bigint")).alias("contact_id"),
        F.col("_recipient").alias("recipient"),
        keep("s_attributes", F.lit("{}")).alias("attributes"),
        keep("s_message_size", F.lit(0).cast("int")).alias("message_size"),
        ts.alias("sent_on"),
        F.lit(0).cast("tinyint").alias("priority"),
        keep("s_queue_id", F.lit(1).cast("int")).alias("queue_id"),
        F.lit(0).cast("int").alias("connection_id"),
        F.col("status").cast("tinyint").alias("status"),
        keep("s_total_open", F.lit(0).cast("tinyint")).alias("total_open"),
        keep("s_total_click", F.lit(0).cast("tinyint")).alias("total_click"),
        keep("s_drop_reason", F.lit(None).cast("string")).alias("drop_reason"),
        F.lit(1).cast("tinyint").alias("soft_bounce_retry"),
        F.lit(0).cast("tinyint").alias("total_open_amp"),
        F.lit(0).cast("tinyint").alias("total_click_amp"),
        F.col("message_id"),
        F.col("_channel").alias("channel"),
        F.col("code").cast("string").alias("dlr_code"),
        ts.alias("dlr_at"),
        F.lit("upsert").alias("_op"),
        ts.alias("_ts"),
        F.col("seq").cast("bigint").alias("_seq"),
    )
    events = ok.select(
        F.col("_id").alias("id"), "message_id", F.col("_campaign").alias("campaign_id"),
        F.col("_channel").alias("channel"), F.col("status").cast("tinyint").alias("status"),
        F.col("code").cast("string").alias("code"), F.col("reason").cast("string").alias("reason"),
        ts.alias("created_at"), F.to_date(ts).alias("dt"))
    at = F.instr(F.col("_recipient"), "@")
    logs = ok.select(
        F.col("_campaign").cast("int").alias("channel_id"), "message_id",
        F.hour(ts).cast("tinyint").alias("request_hour"), F.lit("127.0.0.1").alias("sent_ip"),
        F.lit(0).alias("connection_id"), F.lit(0).alias("mta_route_id"),
        F.when(F.col("_channel") == "sms", F.lit(2)).otherwise(F.lit(1)).cast("tinyint").alias("type"),
        F.col("status").cast("tinyint").alias("status"), F.col("_recipient").alias("recipient"),
        *[F.lit(0).cast("tinyint").alias(c) for c in ("opened", "clicked", "is_unsubscribed", "is_spammed")],
        F.unix_timestamp(ts).cast("int").alias("updated_at"), F.lit("{}").alias("data"),
        # domain = text after the first '@', '' when there is none
        F.when(at > 0, F.expr("substr(_recipient, instr(_recipient, '@') + 1)"))
         .otherwise(F.lit("")).alias("recipient_domain"),
        F.lit("").alias("sender_domain"), F.lit("").alias("template_id"), F.lit("{}").alias("unique_arguments"),
        F.to_date(ts).alias("dt"), F.lit("upsert").alias("_op"), ts.alias("_ts"),
        F.col("seq").cast("bigint").alias("_seq"), F.col("_id").alias("_receipt"))
    return sub_delta, events, logs
