"""Views derived from the driver's tables, with the reference's column roles.

Each view is built once as DataFrame code (``*_df``) and once as a SQL CTE
(``*_SQL``) for the DuckDB oracle.  Modulo arithmetic only *derives
attribute values* (to induce NULLs, blanks and duplicates); no row of the
source tables is ever dropped to make a check cheaper.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC, the fixed "now" of the reports
AS_OF = _dt.datetime(2024, 1, 1)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]


# -- lake contact ------------------------------------------------------------------
def lake_contact_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = tables(spark, sf_dir, "customer", "nation", "region")
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey) \
                .join(region, nation.n_regionkey == region.r_regionkey)
    k = F.col("c_custkey")
    email = (F.when(k % 13 == 0, F.lit("  "))
             .when(k % 17 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("user"), (k % 60).cast("string"), F.lit("@"),
                                 F.lower("c_mktsegment"), F.lit(".example.com"))))
    f7 = F.when(k % 23 == 0, F.lit("not-a-date")).otherwise(
        F.date_add(F.lit(_dt.date(2015, 1, 1)), (k % 3000).cast("int")).cast("string"))
    out = c.select(
        k.cast("bigint").alias("id"),
        F.col("c_nationkey").cast("int").alias("account_id"),
        F.concat(F.lit("pk_"), k.cast("string")).alias("primary_key"),
        email.alias("email"),
        F.when(k % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))).alias("mobile"),
        (F.lit(1600000000) + k * 60).cast("int").alias("created_at"),
        F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.lit(None))
         .otherwise(F.lit(AS_OF_EPOCH) - (k % 10) * 86400).cast("int").alias("last_emailed"),
        F.when(k % 4 == 0, F.lit(None))
         .otherwise(F.lit(AS_OF_EPOCH) - (k % 7) * 3600).cast("int").alias("last_sms"),
        (k % 7).cast("tinyint").alias("email_status"),
        (k % 6).cast("tinyint").alias("sms_status"),
        F.when(k % 20 == 0, 1).otherwise(0).cast("tinyint").alias("is_deleted"),
        F.lit(1).cast("tinyint").alias("is_contact"),
        F.lit(0).cast("tinyint").alias("is_preview"),
        (k % 6 + 1).cast("tinyint").alias("import_source"),
        F.col("c_name").alias("f2"),
        F.when(k % 5 == 4, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("f6"),
        f7.alias("f7"),
        F.col("n_name").alias("f18"),
        F.col("c_mktsegment").alias("f30"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(25 + k % 46).cast("tinyint").alias("f31"),
    )
    part = F.split_part(F.col("email"), F.lit("@"), F.lit(2))
    return out.withColumn("domain", F.when(part != "", part))


LAKE_CONTACT_SQL = f"""
lake_contact AS (
  SELECT CAST(c_custkey AS BIGINT) AS id,
         CAST(c_nationkey AS INTEGER) AS account_id,
         'pk_' || CAST(c_custkey AS VARCHAR) AS primary_key,
         CASE WHEN c_custkey % 13 = 0 THEN '  '
              WHEN c_custkey % 17 = 0 THEN NULL
              ELSE 'user' || CAST(c_custkey % 60 AS VARCHAR) || '@' || lower(c_mktsegment) || '.example.com' END AS email,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS mobile,
         CAST(1600000000 + c_custkey * 60 AS INTEGER) AS created_at,
         CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN NULL
                   ELSE {AS_OF_EPOCH} - (c_custkey % 10) * 86400 END AS INTEGER) AS last_emailed,
         CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {AS_OF_EPOCH} - (c_custkey % 7) * 3600 END AS INTEGER) AS last_sms,
         CAST(c_custkey % 7 AS TINYINT) AS email_status,
         CAST(c_custkey % 6 AS TINYINT) AS sms_status,
         CAST(CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_deleted,
         CAST(1 AS TINYINT) AS is_contact,
         CAST(0 AS TINYINT) AS is_preview,
         CAST(c_custkey % 6 + 1 AS TINYINT) AS import_source,
         c_name AS f2,
         CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE r_name END AS f6,
         CASE WHEN c_custkey % 23 = 0 THEN 'not-a-date'
              ELSE CAST(DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS VARCHAR) END AS f7,
         n_name AS f18,
         c_mktsegment AS f30,
         CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 25 + c_custkey % 46 END AS TINYINT) AS f31
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
contact AS (
  SELECT *, NULLIF(split_part(email, '@', 2), '') AS domain FROM lake_contact
)"""


# -- block files ----------------------------------------------------------------------
def block_file_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """56: customers with an urgent order above 400000; 57: customers with a
    pending order above 450000, plus NULL identifiers for pending low-priority
    orders below 5000.  One row per order, so identifiers repeat."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey)
    b56 = j.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)) \
           .select(F.lit(56).cast("bigint").alias("block_file_id"), F.col("c_name").alias("unique_identifier"))
    b57 = j.filter(((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000))
                   | ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
                      & (F.col("o_totalprice") < 5000))) \
           .select(F.lit(57).cast("bigint").alias("block_file_id"),
                   F.when(F.col("o_totalprice") < 5000, F.lit(None).cast("string"))
                    .otherwise(F.col("c_name")).alias("unique_identifier"))
    return b56.unionAll(b57)


BLOCK_SQL = """
block_file_data AS (
  SELECT CAST(56 AS BIGINT) AS block_file_id, c_name AS unique_identifier
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
  UNION ALL
  SELECT CAST(57 AS BIGINT) AS block_file_id,
         CASE WHEN o_totalprice < 5000 THEN NULL ELSE c_name END AS unique_identifier
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE (o_orderstatus = 'P' AND o_totalprice > 450000)
     OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND o_totalprice < 5000)
)"""


# -- subscribers (campaign_sub) -----------------------------------------------------------
def campaign_sub_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    camp = (F.col("o_custkey") % 20 + 1).cast("bigint")
    return orders.select(
        camp.alias("campaign_id"),
        F.concat(F.lit("pk_"), F.col("o_custkey").cast("string")).alias("primary_key"),
        F.lit(1).cast("bigint").alias("version_id"),
        F.col("o_custkey").cast("bigint").alias("contact_id"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("recipient"),
        F.concat(F.lit("email-"), camp.cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("message_id"),
        F.lit("email").alias("channel"),
        F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 10)
         .otherwise(0).cast("tinyint").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("sent_on"),
        F.lit("upsert").alias("_op"),
        F.col("o_orderdate").cast("timestamp").alias("_ts"),
        F.col("o_orderkey").cast("bigint").alias("_seq"),
    )


CAMPAIGN_SUB_SQL = """
campaign_sub AS (
  SELECT CAST(o_custkey % 20 + 1 AS BIGINT) AS campaign_id,
         'pk_' || CAST(o_custkey AS VARCHAR) AS primary_key,
         CAST(1 AS BIGINT) AS version_id,
         CAST(o_custkey AS BIGINT) AS contact_id,
         'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS recipient,
         'email-' || CAST(o_custkey % 20 + 1 AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS message_id,
         'email' AS channel,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'P' THEN 10 ELSE 0 END AS TINYINT) AS status,
         o_orderdate AS sent_on,
         'upsert' AS _op,
         o_orderdate AS _ts,
         CAST(o_orderkey AS BIGINT) AS _seq
  FROM orders
)"""


# -- receipts ---------------------------------------------------------------------------------
def receipts_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per line item for its order's message.  Line 7 receipts name
    an unknown sms message; those with return flag N carry no campaign id and
    are rejected."""
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    j = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    camp = (F.col("o_custkey") % 20 + 1).cast("bigint")
    unknown = F.col("l_linenumber") == 7
    return j.select(
        F.when(unknown, F.concat(F.lit("sms-"), camp.cast("string"), F.lit("-"), F.col("l_orderkey").cast("string")))
         .otherwise(F.concat(F.lit("email-"), camp.cast("string"), F.lit("-"), F.col("l_orderkey").cast("string")))
         .alias("message_id"),
        F.when(unknown & (F.col("l_returnflag") == "N"), F.lit(0).cast("bigint")).otherwise(camp).alias("campaign_id"),
        F.when(unknown, F.lit("sms")).otherwise(F.lit("")).alias("channel"),
        F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 4).otherwise(5)
         .cast("int").alias("status"),
        F.concat(F.lit("D"), F.col("l_linestatus")).alias("code"),
        F.col("l_returnflag").alias("reason"),
        F.col("l_shipdate").cast("timestamp").alias("received_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"),
    )


RECEIPTS_SQL = """
receipts AS (
  SELECT CASE WHEN l_linenumber = 7
              THEN 'sms-' || CAST(o_custkey % 20 + 1 AS VARCHAR) || '-' || CAST(l_orderkey AS VARCHAR)
              ELSE 'email-' || CAST(o_custkey % 20 + 1 AS VARCHAR) || '-' || CAST(l_orderkey AS VARCHAR) END AS message_id,
         CAST(CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 0 ELSE o_custkey % 20 + 1 END AS BIGINT) AS campaign_id,
         CASE WHEN l_linenumber = 7 THEN 'sms' ELSE '' END AS channel,
         CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 4 ELSE 5 END AS status,
         'D' || l_linestatus AS code,
         l_returnflag AS reason,
         l_shipdate AS received_at,
         CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


# -- change rows from events ---------------------------------------------------------------------
SPLIT_TS = _dt.datetime(2024, 1, 15)


def event_changes_df(spark: SparkSession, sf_dir: str, deletes: bool = True) -> tuple[DataFrame, DataFrame]:
    """(snapshot, delta) change rows keyed by user_id; 'error' events are
    tombstones when ``deletes``."""
    (events,) = tables(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert")) if deletes \
        else F.lit("upsert")
    rows = events.select("user_id", "event_type", "value", "event_id", "ts", "props",
                         op.alias("_op"), F.col("ts").alias("_ts"), F.col("event_id").alias("_seq"))
    snap = rows.filter(F.col("ts") < F.lit(SPLIT_TS))
    delta = rows.filter(F.col("ts") >= F.lit(SPLIT_TS))
    return snap, delta


def event_changes_sql(deletes: bool = True) -> str:
    op = "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END" if deletes else "'upsert'"
    return f"""
changes AS (
  SELECT user_id, event_type, value, event_id, ts, props, {op} AS _op, ts AS _ts, event_id AS _seq
  FROM events
)"""
