"""Driver queries for merge-on-read, paging, search, campaigns and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.operators.campaigns import apply_receipts, evaluate_segments, launch_queue, segment_membership
from cohorta.operators.merge import merge_latest, union_by_name
from cohorta.operators.paging import (filter_logs, keyset_page, lookup, newest_first, page,
                                      search_contacts, search_subscribers)
from cohorta.operators.audience import to_tree, prepare
from cohorta.operators.stats import assign_ids, scope, status_breakdown
from cohorta.plans.derived import (AS_OF, CAMPAIGN_SUB_SQL, LAKE_CONTACT_SQL, RECEIPTS_SQL,
                                   campaign_sub_df, event_changes_df, event_changes_sql,
                                   lake_contact_df, receipts_df, tables)
from cohorta.plans.q_filters import SEGMENT_DEFS, S101, S102, S104
from cohorta.plans.registry import register
from cohorta.schema import sftp_catalog_for

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def ts_str(c):
    return F.date_format(F.col(c), TS_FMT)


# -- M1, W1, U1: latest row per key ------------------------------------------------------------------
def _merged_events(spark, sf_dir, deletes):
    snap, delta = event_changes_df(spark, sf_dir, deletes)
    m = merge_latest(union_by_name(snap, delta), "user_id")
    return m.select("user_id", "event_type", "event_id", ts_str("ts").alias("ts"), F.round("value", 4).alias("value"))


def _merged_events_sql(deletes):
    flt = " AND _op <> 'delete'" if deletes else ""
    return f"""WITH {event_changes_sql(deletes)},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY _ts DESC, _seq DESC) AS _rn FROM changes)
SELECT user_id, event_type, event_id, {TS_SQL.format(c='ts')} AS ts, round(value, 4) AS value
FROM ranked WHERE _rn = 1{flt}"""


register("merge_latest", _merged_events_sql(False))(lambda spark, d: _merged_events(spark, d, False))
register("merge_tombstones", _merged_events_sql(True))(lambda spark, d: _merged_events(spark, d, True))


# -- W3, K5: three-part order, NULL op counts as upsert ---------------------------------------------------
@register("merge_three_key", """WITH changes AS (
  SELECT user_id, event_id, event_type, CAST(floor(value) AS INTEGER) AS updated_at,
         CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' THEN NULL ELSE 'upsert' END AS _op,
         ts AS _ts, event_id AS _seq FROM events),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY updated_at DESC, _ts DESC, _seq DESC) AS _rn FROM changes)
SELECT user_id, event_id, event_type, updated_at FROM ranked WHERE _rn = 1 AND COALESCE(_op, 'upsert') <> 'delete'""")
def q_merge_three_key(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    ch = events.select("user_id", "event_id", "event_type", F.floor("value").cast("int").alias("updated_at"),
                       F.when(F.col("event_type") == "error", F.lit("delete"))
                        .when(F.col("event_type") == "view", F.lit(None).cast("string"))
                        .otherwise(F.lit("upsert")).alias("_op"),
                       F.col("ts").alias("_ts"), F.col("event_id").alias("_seq"))
    return merge_latest(ch, "user_id", ("updated_at", "_ts", "_seq"), null_op_is_upsert=True)


# -- U1, S2-S3: snapshot and delta with different columns ------------------------------------------------
@register("merge_schema_evolution", """WITH snap AS (
  SELECT user_id, event_id, event_type, 'upsert' AS _op, ts AS _ts, event_id AS _seq FROM events WHERE ts < TIMESTAMP '2024-01-15'),
delta AS (
  SELECT user_id, event_id, props, CAST(value > 50 AS INTEGER) AS big, 'upsert' AS _op, ts AS _ts, event_id AS _seq
  FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
allr AS (SELECT * FROM snap UNION ALL BY NAME SELECT * FROM delta),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY _ts DESC, _seq DESC) AS _rn FROM allr)
SELECT user_id, event_id, event_type, props, big FROM ranked WHERE _rn = 1 AND _op <> 'delete'""")
def q_merge_schema_evolution(spark, sf_dir):
    snap, delta = event_changes_df(spark, sf_dir, deletes=False)
    s = snap.select("user_id", "event_id", "event_type", "_op", "_ts", "_seq")
    d = delta.select("user_id", "event_id", "props", (F.col("value") > 50).cast("int").alias("big"), "_op", "_ts", "_seq")
    return merge_latest(union_by_name(s, d), "user_id").select("user_id", "event_id", "event_type", "props", "big")


# -- D4: the same id in several accounts stays separate ----------------------------------------------------
@register("merge_cross_account", """WITH changes AS (
  SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS account_id,
         o_custkey AS id, o_orderkey, round(o_totalprice, 2) AS price, 'upsert' AS _op, o_orderdate AS _ts, o_orderkey AS _seq
  FROM orders),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, id ORDER BY _ts DESC, _seq DESC) AS _rn FROM changes)
SELECT account_id, id, o_orderkey, price FROM ranked WHERE _rn = 1""")
def q_merge_cross_account(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    ch = orders.select(
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
         .cast("bigint").alias("account_id"),
        F.col("o_custkey").alias("id"), "o_orderkey", F.round("o_totalprice", 2).alias("price"),
        F.lit("upsert").alias("_op"), F.col("o_orderdate").alias("_ts"), F.col("o_orderkey").alias("_seq"))
    return merge_latest(ch, ("account_id", "id"))


# -- A8: status breakdown per campaign ----------------------------------------------------------------------------
@register("status_breakdown", f"""WITH {CAMPAIGN_SUB_SQL},
g AS (SELECT campaign_id, CAST(status AS INTEGER) AS status, CAST(count(*) AS BIGINT) AS cnt, min(channel) AS channel
      FROM campaign_sub GROUP BY campaign_id, status)
SELECT campaign_id, status, cnt, CAST(sum(cnt) OVER (PARTITION BY campaign_id) AS BIGINT) AS total,
       min(channel) OVER (PARTITION BY campaign_id) AS channel FROM g""")
def q_status_breakdown(spark, sf_dir):
    sub = campaign_sub_df(spark, sf_dir)
    out = status_breakdown(merge_latest(sub, ("campaign_id", "message_id")))
    return out.withColumn("status", F.col("status").cast("int"))


# -- A9: ids for a batch of new campaigns ----------------------------------------------------------------------------
@register("assign_ids", """WITH maxes AS (
  SELECT CAST(o_custkey % 25 AS BIGINT) AS account_id, max(o_orderkey % 1000) AS max_id FROM orders GROUP BY 1),
new AS (SELECT CAST(c_nationkey AS BIGINT) AS account_id, c_name AS name, c_custkey AS created_at FROM customer)
SELECT n.account_id, n.name, CAST(COALESCE(m.max_id, 0) + ROW_NUMBER() OVER (PARTITION BY n.account_id ORDER BY n.created_at, n.name) AS BIGINT) AS id
FROM new n LEFT JOIN maxes m ON n.account_id = m.account_id""")
def q_assign_ids(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    existing = orders.select((F.col("o_custkey") % 25).cast("bigint").alias("account_id"),
                             (F.col("o_orderkey") % 1000).alias("id"))
    new = customer.select(F.col("c_nationkey").cast("bigint").alias("account_id"), F.col("c_name").alias("name"),
                          F.col("c_custkey").alias("created_at"))
    return assign_ids(new, existing).select("account_id", "name", F.col("id").cast("bigint"))


# -- T1-T5 ------------------------------------------------------------------------------------------------------------------
WITH_CONTACT = "WITH " + LAKE_CONTACT_SQL


@register("page_offset", f"""{WITH_CONTACT},
r AS (SELECT account_id, id, CAST(f31 AS INTEGER) AS f31,
             ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY f31 DESC NULLS LAST, id ASC NULLS LAST) AS rn
      FROM contact WHERE is_deleted = 0)
SELECT account_id, id, f31, rn - 2 AS page_rank FROM r WHERE rn > 2 AND rn <= 7""")
def q_page_offset(spark, sf_dir):
    df = scope(lake_contact_df(spark, sf_dir))
    out = page(df, "f31", "DESC", limit=5, offset=2, by="account_id", tie="id")
    return out.select("account_id", "id", F.col("f31").cast("int"), F.col("page_rank").cast("bigint"))


@register("page_keyset", f"""{WITH_CONTACT},
r AS (SELECT account_id, id, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY id) AS rn FROM contact WHERE is_deleted = 0),
f AS (SELECT * FROM r WHERE rn <= 11),
g AS (SELECT account_id, max(rn) > 10 AS has_more FROM f GROUP BY account_id)
SELECT f.account_id, f.id, CAST(g.has_more AS INTEGER) AS has_more,
       max(f.id) OVER (PARTITION BY f.account_id) AS next_after
FROM f JOIN g USING (account_id) WHERE f.rn <= 10""")
def q_page_keyset(spark, sf_dir):
    df = scope(lake_contact_df(spark, sf_dir)).select("account_id", "id")
    out = keyset_page(df, "id", after=0, limit=10, by="account_id")
    return out.select("account_id", "id", F.col("has_more").cast("int"), "next_after")


@register("newest_first", f"""WITH {CAMPAIGN_SUB_SQL},
r AS (SELECT campaign_id, message_id, sent_on,
             ROW_NUMBER() OVER (PARTITION BY campaign_id ORDER BY sent_on DESC NULLS LAST, message_id) AS rn FROM campaign_sub)
SELECT campaign_id, message_id, {TS_SQL.format(c='sent_on')} AS sent_on, rn AS page_rank FROM r WHERE rn <= 3""")
def q_newest_first(spark, sf_dir):
    sub = merge_latest(campaign_sub_df(spark, sf_dir), ("campaign_id", "message_id"))
    out = newest_first(sub, "sent_on", limit=3, tie="message_id", by="campaign_id")
    return out.select("campaign_id", "message_id", ts_str("sent_on").alias("sent_on"), F.col("page_rank").cast("bigint"))


@register("key_lookup", f"""{WITH_CONTACT}
SELECT account_id, id FROM contact WHERE id IN (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def q_key_lookup(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    keys = orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")) \
                 .select(F.col("o_custkey").alias("id"))
    return lookup(lake_contact_df(spark, sf_dir), keys, "id").select("account_id", "id")


# -- F36-F38 ----------------------------------------------------------------------------------------------------------------
def wh_contact_df(spark, sf_dir):
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("account_id"),
                    F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"),
                    F.col("c_name").alias("first_name"), F.col("n_name").alias("last_name"),
                    F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("company"),
                    F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("city"))


WH_CONTACT_SQL = """wh_contact AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS account_id, 'user' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email,
         c_name AS first_name, n_name AS last_name,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS company,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@register("search_contacts", f"""WITH {WH_CONTACT_SQL}
SELECT account_id, id FROM wh_contact WHERE
  CAST(email AS VARCHAR) ILIKE '%r#00000011%' OR CAST(first_name AS VARCHAR) ILIKE '%r#00000011%'
  OR CAST(last_name AS VARCHAR) ILIKE '%r#00000011%' OR CAST(COALESCE(company, '') AS VARCHAR) ILIKE '%r#00000011%'
  OR CAST(COALESCE(city, '') AS VARCHAR) ILIKE '%r#00000011%'
UNION ALL
SELECT account_id, id FROM wh_contact WHERE
  CAST(email AS VARCHAR) ILIKE '%mach_ne%' OR CAST(first_name AS VARCHAR) ILIKE '%mach_ne%'
  OR CAST(last_name AS VARCHAR) ILIKE '%mach_ne%' OR CAST(COALESCE(company, '') AS VARCHAR) ILIKE '%mach_ne%'
  OR CAST(COALESCE(city, '') AS VARCHAR) ILIKE '%mach_ne%'""")
def q_search_contacts(spark, sf_dir):
    df = wh_contact_df(spark, sf_dir)
    # '_' in the search text is a wildcard (the search is not escaped)
    return search_contacts(df, "r#00000011").select("account_id", "id") \
        .unionAll(search_contacts(df, "mach_ne").select("account_id", "id"))


@register("search_subscribers", f"""WITH {CAMPAIGN_SUB_SQL}
SELECT campaign_id, message_id, CAST(status AS INTEGER) AS status FROM campaign_sub
WHERE (recipient ILIKE '%r12%' OR primary_key ILIKE '%r12%' OR message_id ILIKE '%-12%') AND status = 3""")
def q_search_subscribers(spark, sf_dir):
    sub = merge_latest(campaign_sub_df(spark, sf_dir), ("campaign_id", "message_id"))
    a = search_subscribers(sub, "r12", 3)
    b = search_subscribers(sub, "-12", 3)
    return a.union(b).distinct().select("campaign_id", "message_id", F.col("status").cast("int"))


def _receipt_outputs(spark, sf_dir, carry_forward=False):
    sub = merge_latest(campaign_sub_df(spark, sf_dir), ("campaign_id", "message_id"))
    return apply_receipts(receipts_df(spark, sf_dir), sub, carry_forward=carry_forward)


_R = f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
j AS (SELECT r.*, s.campaign_id AS s_campaign_id, s.channel AS s_channel, s.recipient AS s_recipient,
             s.primary_key AS s_primary_key, s.version_id AS s_version_id, s.contact_id AS s_contact_id
      FROM receipts r LEFT JOIN campaign_sub s USING (message_id)),
ok AS (SELECT *, CAST(COALESCE(NULLIF(campaign_id, 0), s_campaign_id) AS BIGINT) AS _campaign,
              COALESCE(NULLIF(channel, ''), s_channel, COALESCE(channel, '')) AS _channel,
              COALESCE(s_recipient, '') AS _recipient
       FROM j WHERE s_campaign_id IS NOT NULL OR COALESCE(campaign_id, 0) <> 0)"""


@register("apply_receipts", f"""{_R}
SELECT _campaign AS campaign_id, message_id, COALESCE(s_primary_key, _recipient) AS primary_key,
       COALESCE(s_contact_id, 0) AS contact_id, _recipient AS recipient, _channel AS channel, status,
       code AS dlr_code, {TS_SQL.format(c='received_at')} AS dlr_at, seq AS _seq FROM ok""")
def q_apply_receipts(spark, sf_dir):
    sub_delta, _, _, _ = _receipt_outputs(spark, sf_dir)
    return sub_delta.select("campaign_id", "message_id", "primary_key", "contact_id", "recipient", "channel",
                            F.col("status").cast("int"), "dlr_code", ts_str("dlr_at").alias("dlr_at"), "_seq")


@register("receipt_events", f"""{_R}
SELECT message_id, _campaign AS campaign_id, _channel AS channel, status, code, reason,
       {TS_SQL.format(c='received_at')} AS created_at, CAST(CAST(received_at AS DATE) AS VARCHAR) AS dt FROM ok""")
def q_receipt_events(spark, sf_dir):
    _, events, _, _ = _receipt_outputs(spark, sf_dir)
    return events.select("message_id", "campaign_id", "channel", F.col("status").cast("int"), "code", "reason",
                         ts_str("created_at").alias("created_at"), F.col("dt").cast("string").alias("dt"))


@register("receipt_logs", f"""{_R}
SELECT CAST(_campaign AS INTEGER) AS channel_id, message_id, CAST(hour(received_at) AS INTEGER) AS request_hour,
       CASE WHEN _channel = 'sms' THEN 2 ELSE 1 END AS type, status, _recipient AS recipient,
       CAST(epoch(received_at) AS INTEGER) AS updated_at,
       CASE WHEN strpos(_recipient, '@') > 0 THEN substr(_recipient, strpos(_recipient, '@') + 1) ELSE '' END AS recipient_domain,
       CAST(CAST(received_at AS DATE) AS VARCHAR) AS dt FROM ok""")
def q_receipt_logs(spark, sf_dir):
    _, _, logs, _ = _receipt_outputs(spark, sf_dir)
    return logs.select("channel_id", "message_id", F.col("request_hour").cast("int"), F.col("type").cast("int"),
                       F.col("status").cast("int"), "recipient", "updated_at", "recipient_domain",
                       F.col("dt").cast("string").alias("dt"))


@register("receipt_rejects", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL}
SELECT r.message_id, r.seq FROM receipts r LEFT JOIN campaign_sub s USING (message_id)
WHERE s.campaign_id IS NULL AND COALESCE(r.campaign_id, 0) = 0""")
def q_receipt_rejects(spark, sf_dir):
    sub = merge_latest(campaign_sub_df(spark, sf_dir), ("campaign_id", "message_id"))
    rejects = apply_receipts(receipts_df(spark, sf_dir), sub)[3]
    return rejects.select("message_id", "seq")


# -- K6 / F38: api-log list (latest state per message, newest first) ----------------------------------------------------
@register("list_logs", f"""{_R},
logs AS (SELECT CAST(_campaign AS INTEGER) AS channel_id, message_id, status, _recipient AS recipient,
                CAST(epoch(received_at) AS INTEGER) AS updated_at, received_at AS _ts, seq AS _seq FROM ok),
latest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY updated_at DESC, _ts DESC, _seq DESC) AS rn FROM logs),
f AS (SELECT * FROM latest WHERE rn = 1 AND status = 3 AND channel_id = 7
      AND (message_id ILIKE '%-7-1%' OR COALESCE(recipient, '') ILIKE '%-7-1%'))
SELECT channel_id, message_id, status, updated_at FROM f ORDER BY updated_at DESC, message_id LIMIT 20""")
def q_list_logs(spark, sf_dir):
    from cohorta import schema as S
    from cohorta.operators.merge import merge_with_spec
    _, _, logs, _ = _receipt_outputs(spark, sf_dir)
    latest = merge_with_spec(logs, S.API_LOGS_SPEC)
    f = filter_logs(latest, channel_id=7, status=3, q="-7-1")
    return newest_first(f, "updated_at", limit=20, tie="message_id") \
        .select("channel_id", "message_id", F.col("status").cast("int"), "updated_at")


# -- K1: every saved segment in one scan ----------------------------------------------------------------------------------
SEG_SQL = {"101": S101, "102": S102, "104": S104}


def _compiled_segments(df):
    cat = sftp_catalog_for(df)
    fdf, comp = prepare(df, [], cat)
    return {k: comp.compile(to_tree(SEGMENT_DEFS[k], cat, SEGMENT_DEFS)) for k in SEG_SQL}


@register("evaluate_segments", f"{WITH_CONTACT}\n" + "\nUNION ALL\n".join(
    f"SELECT account_id, '{k}' AS segment_id, CAST(SUM(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS cnt "
    f"FROM contact WHERE is_deleted = 0 GROUP BY account_id" for k, v in SEG_SQL.items()))
def q_evaluate_segments(spark, sf_dir):
    df = scope(lake_contact_df(spark, sf_dir))
    return evaluate_segments(df, _compiled_segments(df))


@register("segment_membership", f"{WITH_CONTACT}\n" + "\nUNION ALL\n".join(
    f"SELECT account_id, id, '{k}' AS segment_id FROM contact WHERE is_deleted = 0 AND {v}" for k, v in SEG_SQL.items()))
def q_segment_membership(spark, sf_dir):
    df = scope(lake_contact_df(spark, sf_dir))
    return segment_membership(df, _compiled_segments(df))


# -- K3: launch every account's campaign in one pass ---------------------------------------------------------------------
def campaigns_df(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    return nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("id"),
                         F.col("n_nationkey").cast("bigint").alias("account_id"),
                         F.when(F.col("n_nationkey") % 2 == 0, "email").otherwise("sms").alias("channel"),
                         F.when(F.col("n_regionkey").isin(0, 1), "101").when(F.col("n_regionkey") == 2, "102")
                          .otherwise("104").alias("segment_id"))


@register("launch_queue", f"""{WITH_CONTACT},
camp AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS cid, CAST(n_nationkey AS BIGINT) AS account_id,
                CASE WHEN n_nationkey % 2 = 0 THEN 'email' ELSE 'sms' END AS channel,
                CASE WHEN n_regionkey IN (0, 1) THEN '101' WHEN n_regionkey = 2 THEN '102' ELSE '104' END AS segment_id
         FROM nation),
m AS ({" UNION ALL ".join(f"SELECT *, '{k}' AS segment_id FROM contact WHERE COALESCE(is_deleted, 0) = 0 AND {v}" for k, v in SEG_SQL.items())})
SELECT camp.cid AS campaign_id, m.id AS contact_id,
       CASE WHEN camp.channel = 'sms' THEN m.mobile ELSE m.email END AS recipient,
       printf('%s-%d-%d', camp.channel, camp.cid, m.id) AS message_id, camp.channel AS channel,
       COALESCE(m.primary_key, m.email, CAST(m.id AS VARCHAR)) AS primary_key, 0 AS status, m.id AS _seq
FROM m JOIN camp ON m.account_id = camp.account_id AND m.segment_id = camp.segment_id""")
def q_launch_queue(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    cat = sftp_catalog_for(df)
    _, comp = prepare(df, [], cat)
    trees = {k: to_tree(SEGMENT_DEFS[k], cat, SEGMENT_DEFS) for k in SEG_SQL}
    q = launch_queue(df, campaigns_df(spark, sf_dir), trees, comp, AS_OF)
    return q.select("campaign_id", "contact_id", "recipient", "message_id", "channel", "primary_key",
                    F.col("status").cast("int"), "_seq")


# -- K2: campaign metadata as change rows, latest wins -----------------------------------------------------------------------
def campaign_changes_df(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("id"), (F.col("user_id") % 5 + 1).cast("bigint").alias("account_id"),
        F.concat(F.lit("camp-"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "signup", "draft").when(F.col("event_type").isin("purchase", "view"), "running")
         .when(F.col("event_type") == "click", "paused").otherwise("done").alias("status"),
        F.col("event_id").alias("queued_cnt"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), "delete").otherwise("upsert").alias("_op"),
        F.col("ts").alias("_ts"), F.col("event_id").alias("_seq"))


CAMPAIGN_CHANGES_SQL = """changes AS (
  SELECT user_id AS id, CAST(user_id % 5 + 1 AS BIGINT) AS account_id, 'camp-' || CAST(user_id AS VARCHAR) AS name,
         CASE WHEN event_type = 'signup' THEN 'draft' WHEN event_type IN ('purchase', 'view') THEN 'running'
              WHEN event_type = 'click' THEN 'paused' ELSE 'done' END AS status,
         event_id AS queued_cnt,
         CASE WHEN event_type = 'error' AND value > 50 THEN 'delete' ELSE 'upsert' END AS _op, ts AS _ts, event_id AS _seq
  FROM events),
latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, id ORDER BY _ts DESC, _seq DESC) AS rn
                          FROM changes) WHERE rn = 1 AND _op <> 'delete')"""


@register("campaign_latest", f"WITH {CAMPAIGN_CHANGES_SQL}\nSELECT account_id, id, name, status, queued_cnt FROM latest")
def q_campaign_latest(spark, sf_dir):
    return merge_latest(campaign_changes_df(spark, sf_dir), ("account_id", "id")) \
        .select("account_id", "id", "name", "status", "queued_cnt")


@register("list_campaigns", f"""WITH {CAMPAIGN_CHANGES_SQL},
r AS (SELECT account_id, id, status, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY id DESC) AS page_rank FROM latest)
SELECT account_id, id, status, page_rank FROM r WHERE page_rank <= 5""")
def q_list_campaigns(spark, sf_dir):
    latest = merge_latest(campaign_changes_df(spark, sf_dir), ("account_id", "id"))
    out = newest_first(latest, "id", limit=5, by="account_id")
    return out.select("account_id", "id", "status", F.col("page_rank").cast("bigint"))


# -- T3: offset page of subscribers per campaign, by contact then message -----------------------------------------------
@register("list_subscribers", f"""WITH {CAMPAIGN_SUB_SQL},
r AS (SELECT campaign_id, contact_id, message_id, CAST(status AS INTEGER) AS status,
             ROW_NUMBER() OVER (PARTITION BY campaign_id ORDER BY contact_id, message_id) AS rn
      FROM campaign_sub WHERE status = 3)
SELECT campaign_id, contact_id, message_id, status, rn - 10 AS page_rank FROM r WHERE rn > 10 AND rn <= 60""")
def q_list_subscribers(spark, sf_dir):
    sub = merge_latest(campaign_sub_df(spark, sf_dir), ("campaign_id", "message_id"))
    f = search_subscribers(sub, "", 3)
    out = page(f, "contact_id", "ASC", limit=50, offset=10, by="campaign_id", tie="message_id")
    return out.select("campaign_id", "contact_id", "message_id", F.col("status").cast("int"),
                      F.col("page_rank").cast("bigint"))


# -- P11 + T2 + F36: the contact list (whitelisted columns, search, page with has_more) -----------------------------
@register("list_contacts", f"""WITH {WH_CONTACT_SQL},
m AS (SELECT * FROM wh_contact WHERE
        CAST(email AS VARCHAR) ILIKE '%0_%' OR CAST(first_name AS VARCHAR) ILIKE '%0_%' OR CAST(last_name AS VARCHAR) ILIKE '%0_%'
        OR CAST(COALESCE(company, '') AS VARCHAR) ILIKE '%0_%' OR CAST(COALESCE(city, '') AS VARCHAR) ILIKE '%0_%'),
r AS (SELECT account_id, id, email, city, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY id) AS rn FROM m),
f AS (SELECT * FROM r WHERE rn <= 5 + 20 + 1),
g AS (SELECT account_id, max(rn) > 25 AS has_more FROM f GROUP BY account_id)
SELECT f.account_id, f.id, f.email, f.city, CAST(g.has_more AS INTEGER) AS has_more,
       max(f.id) OVER (PARTITION BY f.account_id) AS next_after
FROM f JOIN g USING (account_id) WHERE f.rn > 5 AND f.rn <= 25""")
def q_list_contacts(spark, sf_dir):
    from cohorta.operators.paging import list_contacts
    from cohorta.schema import CONTACT
    out = list_contacts(wh_contact_df(spark, sf_dir), CONTACT.fieldNames(), q="0_", limit=20, offset=5,
                        columns=["email", "city", "not_a_column"])
    return out.select("account_id", "id", "email", "city", F.col("has_more").cast("int"), "next_after")
