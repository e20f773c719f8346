"""Driver queries that run the write-side jobs (import, compaction, launch
into a warehouse, streams, rewrites) against a scratch warehouse under the
shared checkpoint folder, then read the result back."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.campaigns import apply_receipts
from cohorta.operators.paging import filter_logs
from cohorta.plans.compaction import compact
from cohorta.plans.derived import (AS_OF, BLOCK_SQL, CAMPAIGN_SUB_SQL, LAKE_CONTACT_SQL, RECEIPTS_SQL,
                                   block_file_df, campaign_sub_df, lake_contact_df, receipts_df, tables)
from cohorta.plans.importer import import_activity, import_contacts, import_subscribers
from cohorta.plans.registry import register
from cohorta.session import kept, scratch_dir
from cohorta.sources.readers import conform, scan_lake
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import write_parquet
from cohorta.streaming.streams import RECEIPT_SCHEMA, run_activity_stream, run_dedup_stream, run_receipt_stream

SEC = "yyyy-MM-dd HH:mm:ss"
SEC_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
IMPORT_ACCOUNT = 7


def _sec(c):
    return F.date_format(F.col(c), SEC)


# -- raw contact file with odd text values -----------------------------------------------------------------
def raw_contacts_df(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ks = k.cast("string")
    return customer.select(
        F.when(k % 50 == 0, F.lit("abc")).when(k % 51 == 0, F.lit("0xFFFFFFFFFFFFFFFFFFFF")).when(k % 7 == 0, F.concat(F.lit(" "), ks, F.lit(" ")))
         .when(k % 11 == 0, F.concat(ks, F.lit(".0"))).otherwise(ks).alias("id"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), ks, F.lit("@"), F.lower("c_mktsegment"), F.lit(".test"))).alias("Email"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit("3.7")).when(k % 9 == 2, F.lit("300"))
         .when(k % 9 == 3, F.lit(" 5 ")).when(k % 9 == 4, F.lit("-2.5"))
         .otherwise((k % 7).cast("string")).alias("EMAIL_STATUS"),
        F.when(k % 5 == 0, F.lit("x")).otherwise((k % 6).cast("string")).alias("sms_status"),
        F.when(k % 4 == 0, (F.lit(1700000000) + k).cast("string"))
         .when(k % 4 == 1, F.concat(F.lit("2023-05-0"), (k % 9 + 1).cast("string"), F.lit(" 10:00:00")))
         .when((k % 4 == 2) & (k % 3 == 0), F.lit("2020")).when((k % 4 == 2) & (k % 3 == 1), F.lit("2020-05"))
         .when(k % 4 == 2, F.lit("10:30")).when(k % 5 == 0, F.lit("1700000000000000"))
         .otherwise(F.lit(None).cast("string")).alias("created_at"),
        F.when(k % 3 == 0, (F.lit(1600000000) + k * 10).cast("string")).when(k % 3 == 1, F.lit("99999"))
         .otherwise(F.lit("2022-01-01T08:30:00")).alias("last_emailed"),
        F.concat(F.lit('say "'), F.col("c_name"), F.lit('", ok')).alias("first_name"),
        F.col("c_mktsegment").alias("company"),
        F.when(k % 8 == 0, F.lit("1e2")).otherwise((20 + k % 50).cast("string")).alias("age"),
        F.when(k % 6 == 0, F.lit("1990-2-30")).when(k % 6 == 1, F.lit("2020"))
         .otherwise(F.concat(F.lit("1980-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("date_of_birth"),
    )


RAW_CONTACTS_SQL = """raw AS (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN 'abc' WHEN c_custkey % 51 = 0 THEN 'too long' WHEN c_custkey % 7 = 0 THEN ' ' || CAST(c_custkey AS VARCHAR) || ' '
              WHEN c_custkey % 11 = 0 THEN CAST(c_custkey AS VARCHAR) || '.0' ELSE CAST(c_custkey AS VARCHAR) END AS id,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'u' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.test' END AS email,
         CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN '3.7' WHEN 2 THEN '300' WHEN 3 THEN ' 5 ' WHEN 4 THEN '-2.5'
              ELSE CAST(c_custkey % 7 AS VARCHAR) END AS email_status,
         CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE CAST(c_custkey % 6 AS VARCHAR) END AS sms_status,
         CASE c_custkey % 4 WHEN 0 THEN CAST(1700000000 + c_custkey AS VARCHAR)
              WHEN 1 THEN '2023-05-0' || CAST(c_custkey % 9 + 1 AS VARCHAR) || ' 10:00:00' ELSE NULL END AS created_at,
         CASE WHEN c_custkey % 3 = 0 THEN CAST(1600000000 + c_custkey * 10 AS VARCHAR) WHEN c_custkey % 3 = 1 THEN '99999'
              ELSE '2022-01-01T08:30:00' END AS last_emailed,
         'say "' || c_name || '", ok' AS first_name, c_mktsegment AS company,
         CASE WHEN c_custkey % 8 = 0 THEN '1e2' ELSE CAST(20 + c_custkey % 50 AS VARCHAR) END AS age,
         CASE WHEN c_custkey % 6 = 0 THEN '1990-2-30' WHEN c_custkey % 6 = 1 THEN NULL ELSE '1980-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS date_of_birth
  FROM customer),
canon AS (
  SELECT CAST(7 AS BIGINT) AS account_id, TRY_CAST(id AS BIGINT) AS id,
         COALESCE(email, CAST(TRY_CAST(id AS BIGINT) AS VARCHAR)) AS primary_key, email,
         NULLIF(split_part(email, '@', 2), '') AS domain,
         CAST(COALESCE(TRY_CAST(email_status AS TINYINT), 1) AS INTEGER) AS email_status,
         CAST(COALESCE(TRY_CAST(sms_status AS TINYINT), 1) AS INTEGER) AS sms_status,
         0 AS is_deleted, 0 AS is_preview, 0 AS is_opened, 0 AS is_clicked, 1 AS is_contact, 1 AS import_source,
         COALESCE(TRY_CAST(created_at AS TIMESTAMP),
                  CASE WHEN TRY_CAST(created_at AS BIGINT) > 100000 THEN make_timestamp(TRY_CAST(created_at AS BIGINT) * 1000000) END,
                  TIMESTAMP '2024-01-01 00:00:00') AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' AS updated_at,
         COALESCE(TRY_CAST(last_emailed AS TIMESTAMP),
                  CASE WHEN TRY_CAST(last_emailed AS BIGINT) > 100000 THEN make_timestamp(TRY_CAST(last_emailed AS BIGINT) * 1000000) END) AS last_emailed,
         first_name, company, TRY_CAST(age AS INTEGER) AS age, TRY_CAST(date_of_birth AS DATE) AS date_of_birth,
         'upsert' AS _op, TRY_CAST(id AS BIGINT) AS _seq
  FROM raw WHERE TRY_CAST(id AS BIGINT) IS NOT NULL)"""


def _imported_contacts(spark, sf_dir):
    """Write the raw file as CSV, import it as the account's snapshot, read back."""
    root = scratch_dir(spark, "import-contacts")
    src = f"{root}/src/contacts.csv"
    raw_contacts_df(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(src)
    wh = Warehouse(spark, f"{root}/wh")
    res = import_contacts(wh, src, IMPORT_ACCOUNT, mode="snapshot", now=AS_OF)
    return wh, res


@register("import_contacts", f"""WITH {RAW_CONTACTS_SQL}
SELECT account_id, id, primary_key, email, domain, email_status, sms_status, first_name, company, age,
       CAST(date_of_birth AS VARCHAR) AS date_of_birth, _op, _seq FROM canon""")
def q_import_contacts(spark, sf_dir):
    wh, _ = _imported_contacts(spark, sf_dir)
    c = wh.table("contact", keep_change_columns=True)
    return c.select("account_id", "id", "primary_key", "email", "domain", F.col("email_status").cast("int"),
                    F.col("sms_status").cast("int"), "first_name", "company", "age",
                    F.col("date_of_birth").cast("string"), "_op", "_seq")


@register("import_defaults", f"""WITH {RAW_CONTACTS_SQL}
SELECT id, is_deleted, is_preview, is_opened, is_clicked, is_contact, import_source, email_status, sms_status FROM canon""")
def q_import_defaults(spark, sf_dir):
    wh, _ = _imported_contacts(spark, sf_dir)
    return wh.contact().select("id", *[F.col(c).cast("int") for c in (
        "is_deleted", "is_preview", "is_opened", "is_clicked", "is_contact", "import_source", "email_status", "sms_status")])


@register("import_timestamps", f"""WITH {RAW_CONTACTS_SQL}
SELECT id, {SEC_SQL.format(c='created_at')} AS created_at, {SEC_SQL.format(c='updated_at')} AS updated_at,
       {SEC_SQL.format(c='last_emailed')} AS last_emailed FROM canon""")
def q_import_timestamps(spark, sf_dir):
    wh, _ = _imported_contacts(spark, sf_dir)
    return wh.contact().select("id", _sec("created_at").alias("created_at"), _sec("updated_at").alias("updated_at"),
                               _sec("last_emailed").alias("last_emailed"))


@register("import_row_count", f"""WITH {RAW_CONTACTS_SQL}
SELECT CAST(count(*) AS BIGINT) AS rows FROM canon""")
def q_import_row_count(spark, sf_dir):
    wh, res = _imported_contacts(spark, sf_dir)
    # the count comes from an Observation on the write job itself
    return spark.createDataFrame([(res["rows"],)], "rows bigint")


# -- P9: subscriber import ----------------------------------------------------------------------------------------
def raw_subscribers_df(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.select(
        F.when(F.col("o_orderkey") % 97 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string")).alias("contact_id"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string"), F.lit("@x.test")).alias("recipient"),
        F.when(F.col("o_orderstatus") == "F", "3").when(F.col("o_orderstatus") == "O", "").otherwise("10.4").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("m-"), F.col("o_orderkey").cast("string"))).alias("message_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("sms")).otherwise(F.lit(None).cast("string")).alias("channel"),
        F.lit("1").alias("priority"))


@register("import_subscribers", """WITH raw AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS contact_id,
         'r' || CAST(o_custkey AS VARCHAR) || '@x.test' AS recipient,
         CASE o_orderstatus WHEN 'F' THEN '3' WHEN 'O' THEN '' ELSE '10.4' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'm-' || CAST(o_orderkey AS VARCHAR) END AS message_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'sms' ELSE NULL END AS channel
  FROM orders)
SELECT CAST(9 AS BIGINT) AS campaign_id, TRY_CAST(contact_id AS BIGINT) AS contact_id,
       COALESCE(message_id, printf('msg-%d-%s', 9, CAST(TRY_CAST(contact_id AS BIGINT) AS VARCHAR))) AS message_id,
       CAST(COALESCE(TRY_CAST(status AS TINYINT), 0) AS INTEGER) AS status, COALESCE(channel, 'email') AS channel,
       recipient AS primary_key, 1 AS priority, TRY_CAST(contact_id AS BIGINT) AS _seq
FROM raw WHERE TRY_CAST(contact_id AS BIGINT) IS NOT NULL""")
def q_import_subscribers(spark, sf_dir):
    root = scratch_dir(spark, "import-subs")
    src = f"{root}/src/subs.csv"
    raw_subscribers_df(spark, sf_dir).write.mode("overwrite").option("header", True).csv(src)
    wh = Warehouse(spark, f"{root}/wh")
    import_subscribers(wh, src, 9, mode="delta", now=AS_OF)
    return wh.changes("campaign_sub").select(
        "campaign_id", "contact_id", "message_id", F.col("status").cast("int"), "channel", "primary_key",
        F.col("priority").cast("int"), "_seq")


# -- P10: activity import ----------------------------------------------------------------------------------------------
def raw_activity_df(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select(
        F.when(F.col("event_id") % 101 == 0, F.lit("bad")).otherwise(F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("contact_id"),
        F.when(F.col("event_type") == "click", "2").when(F.col("event_type") == "view", "").otherwise("1").alias("action"),
        (F.col("event_id") % 300).cast("string").alias("link_id"),
        F.date_format("ts", SEC).alias("created_at"),
        F.col("event_type").alias("device"),
        F.lit("3").alias("device_type"))


ACTIVITY_SQL = """raw AS (
  SELECT CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS id, user_id AS contact_id,
         CASE event_type WHEN 'click' THEN '2' WHEN 'view' THEN '' ELSE '1' END AS action,
         CAST(event_id % 300 AS VARCHAR) AS link_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type AS device
  FROM events)
SELECT TRY_CAST(id AS BIGINT) AS id, contact_id, CAST(COALESCE(TRY_CAST(action AS TINYINT), 1) AS INTEGER) AS action,
       CAST(TRY_CAST(link_id AS TINYINT) AS INTEGER) AS link_id, created_at, device, '2024-02-01' AS dt
FROM raw WHERE TRY_CAST(id AS BIGINT) IS NOT NULL"""


def _activity_out(df):
    return df.select("id", "contact_id", F.col("action").cast("int"), F.col("link_id").cast("int"),
                     _sec("created_at").alias("created_at"), "device", F.col("dt").cast("string").alias("dt"))


@register("import_activity", "WITH " + ACTIVITY_SQL)
def q_import_activity(spark, sf_dir):
    root = scratch_dir(spark, "import-activity")
    src = f"{root}/src/activity.csv"
    raw_activity_df(spark, sf_dir).write.mode("overwrite").option("header", True).csv(src)
    wh = Warehouse(spark, f"{root}/wh")
    import_activity(wh, src, "2024-02-01", now=AS_OF)
    return _activity_out(wh.append_table("campaign_activity"))


# -- M2-M5, W4, S8-S11: compaction round trip ---------------------------------------------------------------------------
def _sub_snapshot(spark, sf_dir):
    return conform(campaign_sub_df(spark, sf_dir), S.with_change_columns(S.CAMPAIGN_SUB))


def _tombstones(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    t = orders.filter((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"))
    camp = (F.col("o_custkey") % 20 + 1).cast("bigint")
    rows = t.select(camp.alias("campaign_id"),
                    F.concat(F.lit("email-"), camp.cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("message_id"),
                    F.lit("delete").alias("_op"), F.lit(_dt.datetime(2030, 1, 1)).alias("_ts"),
                    F.col("o_orderkey").cast("bigint").alias("_seq"))
    return conform(rows, S.with_change_columns(S.CAMPAIGN_SUB))


COMPACT_SQL = f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
j AS (SELECT r.*, s.campaign_id AS s_campaign_id FROM receipts r LEFT JOIN campaign_sub s USING (message_id)),
deltas AS (SELECT CAST(COALESCE(NULLIF(campaign_id, 0), s_campaign_id) AS BIGINT) AS campaign_id, message_id,
                  status, code AS dlr_code, 'upsert' AS _op, received_at AS _ts, seq AS _seq
           FROM j WHERE s_campaign_id IS NOT NULL OR COALESCE(campaign_id, 0) <> 0),
tomb AS (SELECT CAST(o_custkey % 20 + 1 AS BIGINT) AS campaign_id,
                'email-' || CAST(o_custkey % 20 + 1 AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS message_id,
                CAST(NULL AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS dlr_code, 'delete' AS _op,
                TIMESTAMP '2030-01-01 00:00:00' AS _ts, o_orderkey AS _seq
         FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O'),
allr AS (SELECT campaign_id, message_id, CAST(status AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS dlr_code, _op, _ts, _seq FROM campaign_sub
         UNION ALL SELECT * FROM deltas UNION ALL SELECT * FROM tomb),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY campaign_id, message_id
                                         ORDER BY _ts DESC, _seq DESC, status DESC NULLS LAST, dlr_code DESC NULLS LAST) AS rn FROM allr)
SELECT campaign_id, message_id, status, dlr_code FROM ranked WHERE rn = 1 AND _op <> 'delete'"""


def _receipt_warehouse(spark, sf_dir, name, sinks=("campaign_sub", "dlr_event", "api_logs")):
    """Scratch warehouse after one receipt batch; writes only the sinks asked for."""
    wh = Warehouse(spark, scratch_dir(spark, name))
    wh.write_snapshot("campaign_sub", _sub_snapshot(spark, sf_dir))
    receipts = kept(spark, receipts_df(spark, sf_dir), "receipts")      # asked for more than once
    several = (lambda r: kept(spark, r, "resolved")) if len(sinks) > 1 else None
    sub_delta, events, logs, _ = apply_receipts(receipts, wh.subscribers_for(receipts), materialize=several)
    if "campaign_sub" in sinks:
        wh.write_delta("campaign_sub", sub_delta, _dt.date(2024, 1, 2))
        wh.write_delta("campaign_sub", _tombstones(spark, sf_dir), _dt.date(2024, 1, 3))
    if "dlr_event" in sinks:
        wh.append("dlr_event", events)
    if "api_logs" in sinks:
        wh.append("api_logs", logs)
    return wh


@register("compact_roundtrip", COMPACT_SQL)
def q_compact_roundtrip(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "compact", sinks=("campaign_sub",))
    compact(wh, "campaign_sub")
    return wh.campaign_sub().select("campaign_id", "message_id", F.col("status").cast("int"), "dlr_code")


_CHANGED = COMPACT_SQL[:COMPACT_SQL.index("allr AS (")]


@register("table_inventory", f"""{_CHANGED}
ok AS (SELECT received_at FROM j WHERE s_campaign_id IS NOT NULL OR COALESCE(campaign_id, 0) <> 0)
SELECT 'campaign_sub_snapshot' AS table_part, CAST(count(DISTINCT campaign_id) AS BIGINT) AS partitions, CAST(count(*) AS BIGINT) AS rows FROM campaign_sub
UNION ALL SELECT 'campaign_sub_delta', CAST(count(DISTINCT (campaign_id, d)) AS BIGINT), CAST(count(*) AS BIGINT)
  FROM (SELECT campaign_id, 1 AS d FROM deltas UNION ALL SELECT campaign_id, 2 FROM tomb)
UNION ALL SELECT t, CAST(count(DISTINCT CAST(received_at AS DATE)) AS BIGINT), CAST(count(*) AS BIGINT)
  FROM ok, (VALUES ('dlr_event'), ('api_logs')) v(t) GROUP BY t""")
def q_table_inventory(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "inventory")
    return wh.inventory().select("table_part", "partitions", "rows")      # the number of files is Spark's choice


# -- S16: full rewrite -----------------------------------------------------------------------------------------------------
@register("full_rewrite", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem""")
def q_full_rewrite(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    out = scratch_dir(spark, "rewrite") + "/lineitem"
    write_parquet(lineitem, out, "overwrite")
    back = spark.read.parquet(out)
    return back.withColumn("l_shipdate", F.date_format("l_shipdate", SEC))


# -- U2 ----------------------------------------------------------------------------------------------------------------------
@register("union_all", f"""WITH {BLOCK_SQL}
SELECT block_file_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(unique_identifier) AS BIGINT) AS keys,
       CAST(count(DISTINCT unique_identifier) AS BIGINT) AS distinct_keys FROM block_file_data GROUP BY block_file_id""")
def q_union_all(spark, sf_dir):
    b = block_file_df(spark, sf_dir)
    return b.groupBy("block_file_id").agg(F.count(F.lit(1)).alias("rows"), F.count("unique_identifier").alias("keys"),
                                          F.count_distinct("unique_identifier").alias("distinct_keys"))


# -- S4, S5, S13: partitioned warehouse scan and Hive-partitioned lake scan --------------------------------------------------
WITH_CONTACT = "WITH " + LAKE_CONTACT_SQL


@register("scan_partitioned", f"""{WITH_CONTACT}
SELECT CAST(account_id AS BIGINT) AS account_id, CAST(count(*) AS BIGINT) AS n, CAST(count(email) AS BIGINT) AS n_email,
       CAST(sum(email_status) AS BIGINT) AS sum_status, CAST(count(f6) AS BIGINT) AS n_f6 FROM contact GROUP BY account_id""")
def q_scan_partitioned(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "scan-wh"))
    lake = lake_contact_df(spark, sf_dir).withColumns({"_op": F.lit("upsert"), "_ts": F.lit(AS_OF), "_seq": F.col("id")})
    wh.write_snapshot("contact", conform(lake, S.with_change_columns(S.CONTACT)))
    c = wh.contact()
    return c.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.count("email").alias("n_email"),
                                       F.sum("email_status").cast("bigint").alias("sum_status"),
                                       F.count("f6").alias("n_f6"))


@register("scan_lake", f"""{WITH_CONTACT}
SELECT account_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(f31) AS BIGINT) AS sum_f31, CAST(count(f2) AS BIGINT) AS n_f2,
       CAST(count(data) AS BIGINT) AS n_data
FROM (SELECT *, CAST(NULL AS BLOB) AS data FROM contact) GROUP BY account_id""")
def q_scan_lake(spark, sf_dir):
    path = scratch_dir(spark, "lake") + "/contact"
    write_parquet(lake_contact_df(spark, sf_dir), path, "overwrite", partition_by=("account_id",))
    lake = scan_lake(spark, path, S.SFTP_CONTACT)  # 68 declared columns; absent ones read as NULL
    return lake.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("f31").cast("bigint").alias("sum_f31"),
                                          F.count("f2").alias("n_f2"), F.count("data").alias("n_data"))


# -- F38 ------------------------------------------------------------------------------------------------------------------------
@register("filter_logs", f"""WITH {CAMPAIGN_SUB_SQL}, {RECEIPTS_SQL},
j AS (SELECT r.*, s.campaign_id AS s_campaign_id, s.recipient AS s_recipient FROM receipts r LEFT JOIN campaign_sub s USING (message_id)),
ok AS (SELECT *, CAST(COALESCE(NULLIF(campaign_id, 0), s_campaign_id) AS INTEGER) AS channel_id, COALESCE(s_recipient, '') AS recipient2
       FROM j WHERE s_campaign_id IS NOT NULL OR COALESCE(campaign_id, 0) <> 0)
SELECT channel_id, message_id, status, CAST(epoch(received_at) AS INTEGER) AS updated_at, CAST(CAST(received_at AS DATE) AS VARCHAR) AS dt
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY received_at DESC, seq DESC) AS rn FROM ok)
WHERE rn = 1 AND channel_id = 3 AND status = 4 AND (message_id ILIKE '%-3-2%' OR COALESCE(recipient2, '') ILIKE '%-3-2%')""")
def q_filter_logs(spark, sf_dir):
    wh = _receipt_warehouse(spark, sf_dir, "logs", sinks=("api_logs",))
    f = filter_logs(wh.api_logs(), channel_id=3, status=4, q="-3-2")
    return f.select("channel_id", "message_id", F.col("status").cast("int"), "updated_at", F.col("dt").cast("string"))


# -- X1-X4: streams ------------------------------------------------------------------------------------------------------------
STREAM_SQL = COMPACT_SQL.replace(" UNION ALL SELECT * FROM tomb", "")


@register("stream_receipts", STREAM_SQL)
def q_stream_receipts(spark, sf_dir):
    root = scratch_dir(spark, "stream-receipts")
    src = f"{root}/in"
    write_parquet(conform(receipts_df(spark, sf_dir), RECEIPT_SCHEMA).hint("rebalance"), src, "overwrite")
    wh = Warehouse(spark, f"{root}/wh")
    wh.write_snapshot("campaign_sub", _sub_snapshot(spark, sf_dir))
    run_receipt_stream(spark, wh, src, f"{root}/checkpoint")
    return wh.campaign_sub().select("campaign_id", "message_id", F.col("status").cast("int"), "dlr_code")


@register("stream_dedup", f"""WITH {RECEIPTS_SQL}
SELECT message_id, seq, status, code, reason FROM (SELECT DISTINCT * FROM receipts)""")
def q_stream_dedup(spark, sf_dir):
    root = scratch_dir(spark, "stream-dedup")
    r = conform(receipts_df(spark, sf_dir), RECEIPT_SCHEMA)
    write_parquet(r.hint("rebalance"), f"{root}/in", "append")
    write_parquet(r.hint("rebalance"), f"{root}/in", "append")  # every receipt delivered twice
    wh = Warehouse(spark, f"{root}/wh")
    run_dedup_stream(spark, wh, f"{root}/in", f"{root}/checkpoint")
    return wh.append_table("receipt").select("message_id", "seq", "status", "code", "reason")


@register("stream_activity", "WITH " + ACTIVITY_SQL)
def q_stream_activity(spark, sf_dir):
    root = scratch_dir(spark, "stream-activity")
    raw = raw_activity_df(spark, sf_dir)
    write_parquet(raw.hint("rebalance"), f"{root}/in", "overwrite")
    wh = Warehouse(spark, f"{root}/wh")
    run_activity_stream(spark, wh, f"{root}/in", raw.schema, f"{root}/checkpoint", "2024-02-01", AS_OF)
    return _activity_out(wh.append_table("campaign_activity"))


# -- M2: contact compaction (full-row upserts and deletes from order activity) ---------------------------------------------
def contact_changes_df(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rows = j.select(
        F.col("c_nationkey").cast("bigint").alias("account_id"), F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
         .cast("tinyint").alias("email_status"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("@orders.test")).alias("email"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "delete")
         .otherwise("upsert").alias("_op"),
        F.col("o_orderdate").cast("timestamp").alias("_ts"), F.col("o_orderkey").alias("_seq"))
    return conform(rows, S.with_change_columns(S.CONTACT))


def _first_contacts(spark, sf_dir):
    """The lake's contacts as a first load."""
    snap = lake_contact_df(spark, sf_dir).withColumns(
        {"_op": F.lit("upsert"), "_ts": F.lit(_dt.datetime(1990, 1, 1)), "_seq": F.col("id")})
    return conform(snap, S.with_change_columns(S.CONTACT))


@register("compact_contacts", f"""{WITH_CONTACT},
snap AS (SELECT CAST(account_id AS BIGINT) AS account_id, id, CAST(email_status AS INTEGER) AS email_status, email,
                'upsert' AS _op, TIMESTAMP '1990-01-01 00:00:00' AS _ts, id AS _seq FROM contact),
delta AS (SELECT CAST(c_nationkey AS BIGINT) AS account_id, o_custkey AS id,
                 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS email_status,
                 'o' || CAST(o_orderkey AS VARCHAR) || '@orders.test' AS email,
                 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'delete' ELSE 'upsert' END AS _op,
                 o_orderdate AS _ts, o_orderkey AS _seq
          FROM orders JOIN customer ON o_custkey = c_custkey),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, id ORDER BY _ts DESC, _seq DESC) AS rn
           FROM (SELECT * FROM snap UNION ALL SELECT * FROM delta))
SELECT account_id, id, email_status, email FROM ranked WHERE rn = 1 AND _op <> 'delete'""")
def q_compact_contacts(spark, sf_dir):
    wh = Warehouse(spark, scratch_dir(spark, "compact-contacts"))
    wh.write_snapshot("contact", _first_contacts(spark, sf_dir))
    wh.write_delta("contact", contact_changes_df(spark, sf_dir), _dt.date(2024, 1, 5))
    compact(wh, "contact")
    return wh.contact().select("account_id", "id", F.col("email_status").cast("int"), "email")
