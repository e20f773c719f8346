"""Driver queries for interrupted compaction, ambiguous and late receipts,
account-scoped reads, saved segments, launch jobs and validated requests."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.audience import audience, parse_query
from cohorta.operators.campaigns import apply_receipts, receipt_id
from cohorta.operators.filters import FilterCompiler
from cohorta.operators.paging import deep_page, filter_logs, list_segments
from cohorta.operators.segments import count_saved_segments, saved_segment_members
from cohorta.plans.audience_book import Audience, AudienceBook
from cohorta.plans.compaction import compact
from cohorta.plans.derived import (AS_OF, CAMPAIGN_SUB_SQL, LAKE_CONTACT_SQL, RECEIPTS_SQL, campaign_sub_df,
                                   lake_contact_df, receipts_df, tables)
from cohorta.plans.importer import import_contacts
from cohorta.plans.launch import apply_receipt_batch, launch_campaigns, save_segments, settle_receipts
from cohorta.plans.q_jobs import (COMPACT_SQL, RAW_CONTACTS_SQL, SEC, SEC_SQL, _imported_contacts, _receipt_warehouse,
                                  _first_contacts, _sub_snapshot, contact_changes_df)
from cohorta.plans.registry import register
from cohorta.schema import sftp_catalog_for
from cohorta.session import scratch_dir
from cohorta.sources.readers import conform, read_source
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import delete_files, write_parquet
from cohorta.streaming.streams import RECEIPT_SCHEMA, run_dedup_stream, run_receipt_stream

WITH_CONTACT = "WITH " + LAKE_CONTACT_SQL


# -- M2, M3, M5: a compaction that stops half way through its removals --------------------------------
class _Stopped(RuntimeError):
    pass


def _stop_half_way(files):
    """Remove the newest half of the files, then fail as a lost driver would."""
    names = files.select("path").distinct().withColumn("half", F.ntile(2).over(
        Window.orderBy(F.col("path").desc())))
    delete_files(names.filter("half = 1").select("path"))
    raise _Stopped


@register("compact_interrupted", COMPACT_SQL)
def q_compact_interrupted(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "compact-stop", sinks=("campaign_sub",))
    try:
        compact(wh, "campaign_sub", remove=_stop_half_way)
    except _Stopped:
        pass
    return wh.campaign_sub().select("campaign_id", "message_id", F.col("status").cast("int"), "dlr_code")


@register("compact_twice", COMPACT_SQL)
def q_compact_twice(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "compact-twice", sinks=("campaign_sub",))
    compact(wh, "campaign_sub")
    compact(wh, "campaign_sub", full=True)     # tombstones that stand alone go now
    return wh.changes("campaign_sub").select("campaign_id", "message_id", F.col("status").cast("int"), "dlr_code")


# -- S10: one replacement whose old files are still there, one that stopped before its switch -------------
@register("replace_at_once", f"""{WITH_CONTACT},
ranked AS (SELECT CAST(c_nationkey AS BIGINT) AS account_id, o_custkey AS id,
                  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS email_status,
                  'o' || CAST(o_orderkey AS VARCHAR) || '@orders.test' AS email,
                  o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS gone,
                  ROW_NUMBER() OVER (PARTITION BY c_nationkey, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7)
SELECT CAST(account_id AS BIGINT) AS account_id, id, CAST(email_status AS INTEGER) AS email_status, email
FROM contact WHERE account_id <> 7
UNION ALL
SELECT account_id, id, CAST(email_status AS INTEGER), email FROM ranked WHERE rn = 1 AND NOT gone""")
def q_replace_at_once(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "replace-at-once"))
    wh.write_snapshot("contact", _first_contacts(spark, sf_dir))
    changes = contact_changes_df(spark, sf_dir)
    wh.replace_partition("contact", changes, 7, keep_old=True)
    stopped = wh.replacements("contact").begin(3)
    wh.add_replacement_rows("contact", changes, stopped)
    return wh.contact().select("account_id", "id", F.col("email_status").cast("int"), "email")


# -- J4, K4: one message id in two campaigns ---------------------------------------------------------------
def _shared_ids(df, receipts: bool):
    """Message ids without their campaign, so that campaigns share them."""
    order = F.regexp_extract("message_id", r"-(\d+)$", 1)
    out = df.withColumn("message_id", F.concat(F.lit("m"), order.cast("bigint").cast("string")))
    if receipts:
        out = out.withColumn("campaign_id", F.when(F.col("seq") % 2 == 0, F.col("campaign_id")).otherwise(F.lit(0)))
    return out


@register("receipts_two_campaigns", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
subs AS (SELECT campaign_id, 'm' || CAST(_seq AS VARCHAR) AS message_id, recipient FROM campaign_sub
         UNION ALL SELECT campaign_id + 100, 'm' || CAST(_seq AS VARCHAR), 'second-' || recipient FROM campaign_sub),
rec AS (SELECT 'm' || CAST((seq - seq % 8) // 8 AS VARCHAR) AS message_id, seq, status,
               CASE WHEN seq % 2 <> 0 OR campaign_id = 0 THEN 0 WHEN seq % 3 = 0 THEN campaign_id + 100 ELSE campaign_id END AS campaign_id
        FROM receipts),
lowest AS (SELECT message_id, min(campaign_id) AS campaign_id FROM subs GROUP BY message_id)
SELECT r.message_id, r.seq, r.status, s.campaign_id, s.recipient
FROM rec r JOIN subs s ON s.message_id = r.message_id AND s.campaign_id = r.campaign_id WHERE r.campaign_id <> 0
UNION ALL
SELECT r.message_id, r.seq, r.status, s.campaign_id, s.recipient
FROM rec r JOIN lowest l ON l.message_id = r.message_id
JOIN subs s ON s.message_id = l.message_id AND s.campaign_id = l.campaign_id WHERE r.campaign_id = 0""")
def q_receipts_two_campaigns(spark, sf_dir):
    subs = _shared_ids(campaign_sub_df(spark, sf_dir), False)
    second = subs.withColumns({"campaign_id": F.col("campaign_id") + 100,
                               "recipient": F.concat(F.lit("second-"), F.col("recipient"))})
    rec = _shared_ids(receipts_df(spark, sf_dir), True)
    rec = rec.withColumn("campaign_id", F.when((F.col("campaign_id") != 0) & (F.col("seq") % 3 == 0),
                                               F.col("campaign_id") + 100).otherwise(F.col("campaign_id")))
    delta = apply_receipts(rec, subs.unionByName(second))[0]
    return delta.select("message_id", F.col("_seq").alias("seq"), F.col("status").cast("int"), "campaign_id", "recipient")


# -- K4, X1: rejects are stored; applying a batch twice adds nothing ---------------------------------------------
@register("receipt_reject_table", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL}
SELECT r.message_id, r.seq, r.status, 'message_id not found' AS error, CAST(CAST(r.received_at AS DATE) AS VARCHAR) AS dt
FROM receipts r LEFT JOIN campaign_sub s ON s.message_id = r.message_id AND s.campaign_id = r.campaign_id
WHERE s.campaign_id IS NULL AND COALESCE(r.campaign_id, 0) = 0""")
def q_receipt_reject_table(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "rejects"))
    wh.write_snapshot("campaign_sub", _sub_snapshot(spark, sf_dir))
    receipts = receipts_df(spark, sf_dir)
    for _ in range(2):
        apply_receipt_batch(wh, receipts)
    return wh.open_rejects().select("message_id", "seq", "status", "error", F.col("dt").cast("string").alias("dt"))


# -- K4, X1: receipts that come before their message is launched ---------------------------------------------------
@register("receipts_before_launch", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
rec AS (SELECT DISTINCT message_id, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE campaign_id END AS BIGINT) AS campaign_id, status, code,
               reason, date_trunc('month', received_at) AS received_at, seq FROM receipts),
sent AS (SELECT message_id, min(campaign_id) AS campaign_id FROM campaign_sub GROUP BY message_id),
told AS (SELECT r.*, CASE WHEN r.campaign_id <> 0 THEN r.campaign_id ELSE s.campaign_id END AS meant
         FROM rec r LEFT JOIN sent s ON s.message_id = r.message_id)
SELECT COALESCE(meant, 0) AS campaign_id, status, reason, code, meant IS NOT NULL AS applied, CAST(count(*) AS BIGINT) AS receipts,
       CAST(sum(seq) AS BIGINT) AS seqs
FROM told GROUP BY ALL""")
def q_receipts_before_launch(spark, sf_dir):
    """Unnamed receipts first, then the others, then all of them again; the messages are launched in between."""
    wh = Warehouse(spark, scratch_dir(spark, "before-launch"))
    rec = conform(receipts_df(spark, sf_dir).withColumns({
        "campaign_id": F.when(F.col("seq") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("campaign_id")),
        "received_at": F.date_trunc("month", "received_at")}), RECEIPT_SCHEMA)
    subs = _sub_snapshot(spark, sf_dir)
    apply_receipt_batch(wh, rec.filter("campaign_id = 0"))
    wh.write_snapshot("campaign_sub", subs)
    settle_receipts(wh, subs)
    apply_receipt_batch(wh, rec)
    # ids (32 letters) meet as the 16 bytes that they write out; an id tells all that its receipt says
    done = wh.append_table("dlr_event").select(F.unhex("id").alias("id"), "campaign_id", F.lit(True).alias("applied"))
    left = wh.open_rejects().select(F.unhex("id").alias("id"), F.lit(0).cast("bigint").alias("campaign_id"), F.lit(False).alias("applied"))
    said = rec.select(F.unhex(receipt_id()).alias("id"), "status", "code", "reason", "seq").dropDuplicates(["id"])
    return done.union(left).join(said, "id").groupBy("campaign_id", "status", "reason", "code", "applied").agg(
        F.count("*").alias("receipts"), F.sum("seq").cast("bigint").alias("seqs"))


# -- X1, X3: receipts far older than any seen before, and repeats of them ----------------------------------------------
@register("stream_late", f"""WITH {RECEIPTS_SQL}
SELECT message_id, seq, status, code, reason FROM (SELECT DISTINCT * FROM receipts)""")
def q_stream_late(spark, sf_dir):
    root = scratch_dir(spark, "stream-late")
    wh = Warehouse(spark, f"{root}/wh")
    rec = conform(receipts_df(spark, sf_dir), RECEIPT_SCHEMA)
    split = F.col("received_at") >= F.lit(_dt.datetime(1995, 6, 1))
    for part in (rec.filter(split), rec.filter(~split), rec):      # newest first, then late ones, then all again
        write_parquet(part.hint("rebalance"), f"{root}/in", "append")
        run_dedup_stream(spark, wh, f"{root}/in", f"{root}/checkpoint")
    return wh.append_table("receipt").select("message_id", "seq", "status", "code", "reason")


# -- S4, F25: one account of the warehouse --------------------------------------------------------------------------------
def _contact_warehouse(spark, sf_dir, name):
    wh = Warehouse(spark, scratch_dir(spark, name))
    lake = lake_contact_df(spark, sf_dir).withColumns({"_op": F.lit("upsert"), "_ts": F.lit(AS_OF), "_seq": F.col("id")})
    wh.write_snapshot("contact", conform(lake, S.with_change_columns(S.CONTACT)))
    return wh


@register("scan_account", f"""{WITH_CONTACT}
SELECT CAST(account_id AS BIGINT) AS account_id, id, email, CAST(email_status AS INTEGER) AS email_status
FROM contact WHERE account_id = 7""")
def q_scan_account(spark, sf_dir):
    wh = _contact_warehouse(spark, sf_dir, "scan-account")
    return wh.contact(7).select("account_id", "id", "email", F.col("email_status").cast("int"))


@register("audience_account", f"""{WITH_CONTACT}
SELECT id FROM contact WHERE account_id = 4 AND is_deleted = 0 AND email_status = 1 AND f30 = 'BUILDING'""")
def q_audience_account(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    spec = {"values": {"email_status": 1, "f30": "BUILDING"}}
    return audience(df, spec, sftp_catalog_for(df), account_id=4).select("id")


# -- P12, T1: a validated request, page and count -----------------------------------------------------------------------------
_ASKED = "account_id = 5 AND is_deleted = 0 AND (f31 >= 30 OR f6 IS NULL)"


@register("parse_query", f"""{WITH_CONTACT},
hit AS (SELECT * FROM contact WHERE {_ASKED})
SELECT id, email, f18, (SELECT CAST(count(*) AS BIGINT) FROM hit) AS cnt FROM hit
ORDER BY f7 DESC NULLS LAST, id LIMIT 15 OFFSET 5""")
def q_parse_query(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    rows, count = parse_query(df, {
        "account_id": 5, "select": ["id", "email", "f18"], "order_by": "f7", "order_dir": "DESC", "limit": 15, "offset": 5,
        "filter": {"op": "or", "children": [{"op": "gte", "field": "f31", "value": 30}, {"op": "is_null", "field": "f6"}]},
    }, sftp_catalog_for(df))
    return rows.join(count)     # one row of counts beside the page


# -- F38 by day: partitions before the day are not read -------------------------------------------------------------------------
@register("list_logs_day", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
ok AS (SELECT r.* FROM receipts r LEFT JOIN campaign_sub s ON s.message_id = r.message_id AND s.campaign_id = r.campaign_id
       WHERE s.campaign_id IS NOT NULL OR COALESCE(r.campaign_id, 0) <> 0),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY received_at DESC, seq DESC) AS rn FROM ok)
SELECT message_id, status, CAST(CAST(received_at AS DATE) AS VARCHAR) AS dt FROM last
WHERE rn = 1 AND CAST(received_at AS DATE) = DATE '1996-03-14'""")
def q_list_logs_day(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "logs-day", sinks=("api_logs",))
    f = filter_logs(wh.api_logs(_dt.date(1996, 3, 14)))
    return f.select("message_id", F.col("status").cast("int"), F.col("dt").cast("string").alias("dt"))


# -- K1, K3, J5, T4, K6: segments from the table, and a launch by them -------------------------------------------------------------
def _segment_rows(spark, sf_dir):
    """Two versions of one segment per account; the later one filters by region."""
    (nation,) = tables(spark, sf_dir, "nation")
    old = json.dumps({"op": "eq", "field": "city", "value": "nowhere"})
    tree = F.concat(F.lit('{"op": "and", "children": [{"op": "gte", "field": "email_status", "value": '),
                    (F.col("n_regionkey") % 4).cast("string"),
                    F.lit('}, {"op": "not_null", "field": "mobile"}]}'))
    base = nation.select(F.concat(F.lit("seg"), F.col("n_nationkey").cast("string")).alias("id"),
                         F.col("n_nationkey").cast("bigint").alias("account_id"), F.col("n_name").alias("name"),
                         tree.alias("filter_json"), F.lit(_dt.datetime(2024, 1, 1)).alias("created_at"),
                         (F.lit(_dt.datetime(2024, 1, 2)) + F.make_interval(days=F.col("n_nationkey").cast("int"))).alias("updated_at"))
    first = base.withColumns({"filter_json": F.lit(old), "updated_at": F.lit(_dt.datetime(2024, 1, 1))})
    return first.unionByName(base)


@register("list_segments", f"""SELECT 'seg' || CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS BIGINT) AS account_id,
n_name AS name, {SEC_SQL.format(c="TIMESTAMP '2024-01-02 00:00:00' + n_nationkey * INTERVAL 1 DAY")} AS updated_at FROM nation""")
def q_list_segments(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "segments"))
    save_segments(wh, _segment_rows(spark, sf_dir))
    return list_segments(wh.segments()).select("id", "account_id", "name", F.date_format("updated_at", SEC).alias("updated_at"))


_CAMPAIGNS = """SELECT CAST(n_nationkey + 100 AS BIGINT) AS cid, CAST(n_nationkey AS BIGINT) AS account_id, n_regionkey
FROM nation WHERE n_regionkey <> 2"""


@register("launch_campaign_job", f"""{WITH_CONTACT},
camp AS ({_CAMPAIGNS})
SELECT camp.cid AS campaign_id, c.id AS contact_id, printf('email-%d-%d', camp.cid, c.id) AS message_id, c.email AS recipient,
       'running' AS campaign_status, CAST(count(*) OVER (PARTITION BY camp.cid) AS BIGINT) AS queued_cnt
FROM contact c JOIN camp ON c.account_id = camp.account_id
WHERE COALESCE(c.is_deleted, 0) = 0 AND c.email_status >= camp.n_regionkey % 4 AND c.mobile IS NOT NULL""")
def q_launch_campaign_job(spark, sf_dir):
    wh = _contact_warehouse(spark, sf_dir, "launch-job")
    save_segments(wh, _segment_rows(spark, sf_dir))
    (nation,) = tables(spark, sf_dir, "nation")
    camps = nation.filter("n_regionkey <> 2").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_nationkey").cast("bigint").alias("account_id"),
        F.col("n_name").alias("name"), F.lit("email").alias("channel"),
        F.concat(F.lit("seg"), F.col("n_nationkey").cast("string")).alias("segment_id"))
    launch_campaigns(wh, camps, now=AS_OF)
    meta = wh.campaign().select(F.col("id").alias("campaign_id"), F.col("status").alias("campaign_status"), "queued_cnt")
    return wh.campaign_sub().join(meta, "campaign_id").select("campaign_id", "contact_id", "message_id", "recipient",
                                                              "campaign_status", "queued_cnt")


# -- S14, K4: rows that an import cannot take are kept ----------------------------------------------------------------------------------
@register("import_rejects", f"""WITH {RAW_CONTACTS_SQL}
SELECT company, first_name, 'no numeric id' AS error FROM raw WHERE TRY_CAST(id AS BIGINT) IS NULL""")
def q_import_rejects(spark, sf_dir):
    wh, _ = _imported_contacts(spark, sf_dir)
    r = wh.append_table("import_reject")
    return r.select(F.get_json_object("row", "$.company").alias("company"),
                    F.get_json_object("row", "$.first_name").alias("first_name"), "error")


# -- X2: the receipt stream run again over the same files from a new checkpoint ---------------------------------------------------------------
@register("stream_replay", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
ok AS (SELECT DISTINCT r.* FROM receipts r LEFT JOIN campaign_sub s ON s.message_id = r.message_id AND s.campaign_id = r.campaign_id
       WHERE s.campaign_id IS NOT NULL OR COALESCE(r.campaign_id, 0) <> 0)
SELECT CAST(CAST(received_at AS DATE) AS VARCHAR) AS dt, CAST(count(*) AS BIGINT) AS events FROM ok GROUP BY 1""")
def q_stream_replay(spark, sf_dir):
    root = scratch_dir(spark, "stream-replay")
    write_parquet(conform(receipts_df(spark, sf_dir), RECEIPT_SCHEMA).hint("rebalance"), f"{root}/in", "overwrite")
    wh = Warehouse(spark, f"{root}/wh")
    wh.write_snapshot("campaign_sub", _sub_snapshot(spark, sf_dir))
    run_receipt_stream(spark, wh, f"{root}/in", f"{root}/first")
    run_receipt_stream(spark, wh, f"{root}/in", f"{root}/second")     # progress lost: every batch runs again
    return wh.append_table("dlr_event").groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("events"))


# -- T1: a page deep in a group ---------------------------------------------------------------------------------------------------
@register("page_deep", """SELECT l_returnflag, l_extendedprice, l_orderkey * 8 + l_linenumber AS line, CAST(rn - 9000 AS INTEGER) AS page_rank
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey * 8 + l_linenumber) AS rn
      FROM lineitem) WHERE rn > 9000 AND rn <= 9040""")
def q_page_deep(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    lines = lineitem.select("l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    return deep_page(lines, "l_extendedprice", "DESC", 40, 9000, by="l_returnflag", tie="line")


# -- T1: order without a limit ------------------------------------------------------------------------------------------------------
@register("parse_query_ordered", f"""{WITH_CONTACT}
SELECT id, f31, CAST(ROW_NUMBER() OVER (ORDER BY f31 DESC NULLS LAST, id) AS BIGINT) AS place
FROM contact WHERE account_id = 9 AND is_deleted = 0 AND f30 <> 'MACHINERY'""")
def q_parse_query_ordered(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    rows, _ = parse_query(df, {"account_id": 9, "select": ["id", "f31"], "order_by": "f31", "order_dir": "desc",
                               "filter": {"op": "neq", "field": "f30", "value": "MACHINERY"}}, sftp_catalog_for(df))
    # the order of the answer itself is what is shown
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


# -- K1: a saved segment for each part, evaluated as bit programs -----------------------------------------------------------------------
SEGMENTS_SQL = f"""{WITH_CONTACT},
seg AS (SELECT CAST(p_partkey % 25 AS BIGINT) AS account_id, 'part' || CAST(p_partkey AS VARCHAR) AS id, 25 + p_size % 46 AS age,
               ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][1 + p_partkey % 5] AS market,
               p_partkey % 3 = 0 AS negated, p_partkey % 7 AS status FROM part),
hit AS (SELECT s.account_id, s.id AS segment_id, c.id,
               (c.f31 >= s.age OR c.f30 = s.market) AND (c.email_status <> s.status OR c.f6 IS NULL) AS inner_test, s.negated
        FROM seg s JOIN contact c ON CAST(c.account_id AS BIGINT) = s.account_id)"""


def _part_segment_rows(spark, sf_dir):
    """A saved segment for each part: (account_id, id, filter_json)."""
    (part,) = tables(spark, sf_dir, "part")
    k = F.col("p_partkey")
    market = F.element_at(F.array(*[F.lit(m) for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")]),
                          (k % 5 + 1).cast("int"))
    tree = F.concat(
        F.lit('{"op": "and", "children": [{"op": "or", "children": [{"op": "gte", "field": "f31", "value": '),
        F.coalesce((F.col("p_size") % 46 + 25).cast("string"), F.lit("null")), F.lit('}, {"op": "eq", "field": "f30", "value": "'), market,
        F.lit('"}]}, {"op": "or", "children": [{"op": "neq", "field": "email_status", "value": '), (k % 7).cast("string"),
        F.lit('}, {"op": "is_null", "field": "f6"}]}]}'))
    negated = F.concat(F.lit('{"op": "not", "children": ['), tree, F.lit("]}"))
    return part.select((k % 25).cast("bigint").alias("account_id"), F.concat(F.lit("part"), k.cast("string")).alias("id"),
                       F.when(k % 3 == 0, negated).otherwise(tree).alias("filter_json"))


@register("segments_many", f"""{SEGMENTS_SQL}
SELECT account_id, segment_id, CAST(count(*) FILTER (CASE WHEN negated THEN NOT inner_test ELSE inner_test END) AS BIGINT) AS cnt
FROM hit GROUP BY account_id, segment_id""")
def q_segments_many(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    comp = FilterCompiler(sftp_catalog_for(df), {f.name: f.dataType for f in df.schema.fields})
    return count_saved_segments(df, _part_segment_rows(spark, sf_dir), comp).withColumn("account_id", F.col("account_id").cast("bigint"))


@register("segments_many_members", f"""{SEGMENTS_SQL}
SELECT account_id, id, segment_id FROM hit WHERE CASE WHEN negated THEN NOT inner_test ELSE inner_test END""")
def q_segments_many_members(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    comp = FilterCompiler(sftp_catalog_for(df), {f.name: f.dataType for f in df.schema.fields})
    return saved_segment_members(df, _part_segment_rows(spark, sf_dir), comp).withColumn("account_id", F.col("account_id").cast("bigint"))


# -- S1: quoted line breaks ---------------------------------------------------------------------------------------------------------
@register("import_line_breaks", """SELECT c_custkey AS id, 'line one' || chr(10) || c_name || ', "' || c_mktsegment || '"' || chr(10) || chr(10) AS address,
'x' || CAST(c_custkey AS VARCHAR) AS city FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, c_name, 'x' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0""")
def q_import_line_breaks(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    root = scratch_dir(spark, "line-breaks")
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("line one\n"), F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"),
                                                                   F.lit('"\n\n')))
    customer.select(k.cast("string").alias("id"), note.alias("address"), F.concat(F.lit("x"), k.cast("string")).alias("city")) \
        .coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/src/contacts.csv")
    rows = read_source(spark, f"{root}/src/contacts.csv")
    return rows.select(F.col("id").cast(customer.schema["c_custkey"].dataType).alias("id"), "address", "city")


# -- S2, S3: a Parquet file and a folder of Parquet files as import sources ------------------------------------------------------------
@register("import_parquet", """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS first_name, CAST(11 AS BIGINT) AS account_id FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 'folder ' || c_name, CAST(12 AS BIGINT) FROM customer""")
def q_import_parquet(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    root = scratch_dir(spark, "import-parquet")
    src = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("folder "), F.col("c_name")).alias("first_name"))
    src.hint("rebalance").write.mode("overwrite").parquet(f"{root}/folder/below")
    src.withColumn("first_name", F.substring("first_name", 8, 200)).write.mode("overwrite").parquet(f"{root}/one.parquet")
    wh = Warehouse(spark, f"{root}/wh")
    import_contacts(wh, f"{root}/one.parquet", 11, mode="snapshot", now=AS_OF)
    import_contacts(wh, f"{root}/folder", 12, mode="snapshot", now=AS_OF)
    return wh.contact().select("id", "first_name", "account_id")


# -- J4, T5: rows by message id ---------------------------------------------------------------------------------------------------------
@register("lookup_messages", f"""WITH {CAMPAIGN_SUB_SQL}
SELECT campaign_id, message_id, recipient FROM campaign_sub
WHERE message_id IN (SELECT 'email-' || CAST(s_suppkey % 20 + 1 AS VARCHAR) || '-' || CAST(s_suppkey AS VARCHAR) FROM supplier)""")
def q_lookup_messages(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "lookup"))
    wh.write_snapshot("campaign_sub", _sub_snapshot(spark, sf_dir))
    (supplier,) = tables(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    keys = supplier.select(F.concat(F.lit("email-"), (k % 20 + 1).cast("string"), F.lit("-"), k.cast("string")).alias("message_id"))
    return wh.lookup("campaign_sub", keys).select("campaign_id", "message_id", "recipient")


# -- A3, A4: audiences kept by bitmaps over days of inserts, moves and deletes ------------------------------
_BOOK_DAYS = [_dt.date(2024, 2, d) for d in (1, 2, 3, 4)]


def _book_changes(spark, sf_dir):
    """A change of its customer's contact per order: e-mails that contacts share and leave, tombstones."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return j.select(
        F.col("c_nationkey").cast("bigint").alias("account_id"), F.col("o_custkey").cast("bigint").alias("id"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 501).cast("string"), F.lit("@orders.test")).alias("email"),
        (F.col("o_orderkey") % 3).cast("tinyint").alias("email_status"),
        (F.col("o_orderkey") % 7).cast("tinyint").alias("sms_status"),
        F.col("o_orderpriority").alias("f6"), F.col("o_orderstatus").alias("f7"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "delete")
         .otherwise("upsert").alias("_op"),
        F.col("o_orderdate").cast("timestamp").alias("_ts"), F.col("o_orderkey").cast("bigint").alias("_seq"),
        (F.col("o_orderkey") % 3).alias("batch"))


_BOOK_SQL = f"""{WITH_CONTACT},
changes AS (SELECT CAST(account_id AS BIGINT) AS account_id, id, email, email_status, sms_status, f6, f7, 'upsert' AS _op,
                   TIMESTAMP '1990-01-01 00:00:00' AS _ts, id AS _seq FROM contact
            UNION ALL
            SELECT CAST(c_nationkey AS BIGINT), o_custkey, 'm' || CAST(o_orderkey % 501 AS VARCHAR) || '@orders.test',
                   o_orderkey % 3, o_orderkey % 7, o_orderpriority, o_orderstatus,
                   CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'delete' ELSE 'upsert' END,
                   o_orderdate, o_orderkey
            FROM orders JOIN customer ON o_custkey = c_custkey),
now AS (SELECT *, NULLIF(TRIM(email), '') AS k FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, id ORDER BY _ts DESC, _seq DESC) AS rn FROM changes)
        WHERE rn = 1 AND _op <> 'delete'),
judged AS (
  SELECT *, 'finished' AS audience, f7 = 'F' AS inc, f6 = '5-LOW' AS exc FROM now
  UNION ALL SELECT *, 'priority' AS audience, f6 IN ('1-URGENT', '2-HIGH') AS inc, FALSE AS exc FROM now)"""


def _book(spark, sf_dir, name):
    wh = Warehouse(spark, scratch_dir(spark, name))
    snap = lake_contact_df(spark, sf_dir).withColumns(
        {"_op": F.lit("upsert"), "_ts": F.lit(_dt.datetime(1990, 1, 1)), "_seq": F.col("id")})
    wh.write_snapshot("contact", conform(snap, S.with_change_columns(S.CONTACT)))
    book = AudienceBook(wh, "campaigns", {
        "finished": Audience(F.col("f7") == "F", F.col("f6") == "5-LOW"),
        "priority": Audience(F.col("f6").isin("1-URGENT", "2-HIGH"))})
    book.build(_BOOK_DAYS[0])
    changes = _book_changes(spark, sf_dir)
    for batch, day in enumerate(_BOOK_DAYS[1:]):
        rows = changes.filter(F.col("batch") == batch)        # each day takes its share, all are taken in
        wh.write_delta("contact", conform(rows.drop("batch"), S.with_change_columns(S.CONTACT)), day)
        book.advance(day)
    return book


@register("audience_book", f"""{_BOOK_SQL}
SELECT audience, account_id,
       COUNT(DISTINCT k) FILTER (email_status = 1 AND inc AND NOT exc) AS cnt,
       COUNT(k) FILTER (email_status = 1 AND inc AND NOT exc)
         - COUNT(DISTINCT k) FILTER (email_status = 1 AND inc AND NOT exc) AS duplicate_count,
       COUNT(*) FILTER (email_status = 1 AND inc) AS include_count,
       COUNT(*) FILTER (email_status = 1 AND inc AND exc) AS exclude_count,
       COUNT(*) FILTER (email_status = 1) AS email_active, COUNT(*) FILTER (email_status = 2) AS email_unsubscribed,
       COUNT(*) FILTER (email_status = 3) AS email_bounced, COUNT(*) FILTER (email_status = 4) AS email_marked_spam,
       COUNT(*) FILTER (email_status = 5) AS email_manually_suppressed,
       COUNT(*) FILTER (email_status = 6) AS email_unconfirmed,
       COUNT(*) FILTER (email_status = 1 AND sms_status = 1) AS sms_active,
       COUNT(*) FILTER (email_status = 1 AND sms_status = 5) AS sms_manually_suppressed,
       COUNT(*) FILTER (email_status IN (2, 3, 4, 5) AND inc) AS email_all_suppressed
FROM judged GROUP BY audience, account_id""")
def q_audience_book(spark, sf_dir):
    return _book(spark, sf_dir, "audience-book").report()


@register("audience_reach", f"""{_BOOK_SQL},
held AS (SELECT account_id, k, COUNT(DISTINCT audience) AS n FROM judged
         WHERE email_status = 1 AND inc AND NOT exc AND k IS NOT NULL GROUP BY account_id, k)
SELECT account_id, COUNT(*) AS any_audience, COUNT(*) FILTER (n = 2) AS all_audiences FROM held GROUP BY account_id""")
def q_audience_reach(spark, sf_dir):
    book = _book(spark, sf_dir, "audience-reach")
    book.fold()
    return book.reach(["finished", "priority"])
