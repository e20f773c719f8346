"""Driver queries for the filter language, rules, block joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.operators.audience import audience, campaign_report, prepare, to_tree
from cohorta.operators.blocks import add_block_flags, block_anti, block_semi, flag_name
from cohorta.operators.stats import count_where, distinct_count, preview, scope, segment_stats
from cohorta.plans.derived import (AS_OF_EPOCH, BLOCK_SQL, LAKE_CONTACT_SQL, block_file_df,
                                   lake_contact_df)
from cohorta.plans.registry import register
from cohorta.schema import sftp_catalog_for

WITH_CONTACT = "WITH " + LAKE_CONTACT_SQL
WITH_BLOCKS = "WITH " + LAKE_CONTACT_SQL + "," + BLOCK_SQL


def _contacts(spark, sf_dir):
    df = lake_contact_df(spark, sf_dir)
    return df, sftp_catalog_for(df)


def _ids(spark, sf_dir, spec, **kw):
    df, cat = _contacts(spark, sf_dir)
    return audience(df, spec, cat, **kw).select("account_id", "id")


def _sql_ids(where: str, deleted: bool = True) -> str:
    scope_sql = "is_deleted = 0 AND " if deleted else ""
    return f"{WITH_CONTACT}\nSELECT account_id, id FROM contact WHERE {scope_sql}({where})"


def leaf(op, field, value=None, values=None, datatype=None):
    n = {"op": op, "field": field}
    if value is not None:
        n["value"] = value
    if values is not None:
        n["values"] = values
    if datatype:
        n["datatype"] = datatype
    return n


def AND(*c):
    return {"op": "and", "children": list(c)}


def OR(*c):
    return {"op": "or", "children": list(c)}


def NOT(c):
    return {"op": "not", "children": [c]}


# -- F4-F9, F12-F13 --------------------------------------------------------------------
T_EQ_NEQ = AND(leaf("eq", "email_status", 1, datatype="tinyint"), leaf("neq", "f6", "ASIA"))
register("filter_eq_neq", _sql_ids("email_status = 1 AND f6 <> 'ASIA'"))(
    lambda spark, d: _ids(spark, d, T_EQ_NEQ))

T_RANGE = AND(leaf("gt", "f31", 30), leaf("lte", "f31", "50"), leaf("gte", "created_at", 1600030000),
              leaf("lt", "sms_status", 5))
register("filter_range", _sql_ids("f31 > 30 AND f31 <= 50 AND created_at >= 1600030000 AND sms_status < 5"))(
    lambda spark, d: _ids(spark, d, T_RANGE))

T_BETWEEN = leaf("between", "f31", values=[30, 40], datatype="tinyint")
register("filter_between", _sql_ids("f31 BETWEEN 30 AND 40"))(lambda spark, d: _ids(spark, d, T_BETWEEN))

T_NOT_BETWEEN = leaf("not_between", "f31", values=[30, 60])
register("filter_not_between", _sql_ids("f31 IS NULL OR f31 NOT BETWEEN 30 AND 60"))(
    lambda spark, d: _ids(spark, d, T_NOT_BETWEEN))

# -- F10-F11, D3 -------------------------------------------------------------------------------
T_IN = AND(leaf("in", "f18", values=["NATION_1", "NATION_2", "NATION_3", "NATION_11", "NATION_24"]),
           leaf("not_in", "f6", values=["ASIA", "EUROPE"]))
register("filter_in_not_in", _sql_ids(
    "f18 IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_11', 'NATION_24') AND (f6 IS NULL OR f6 NOT IN ('ASIA', 'EUROPE'))"))(
    lambda spark, d: _ids(spark, d, T_IN))

T_EMPTY = OR(leaf("in", "f18", values=[]), AND(leaf("not_in", "f6", values=[]), leaf("eq", "email_status", 2)),
             AND(OR(), leaf("eq", "sms_status", 4)))
register("filter_empty_lists", _sql_ids("(1 = 0) OR ((1 = 1) AND email_status = 2) OR ((1 = 1) AND sms_status = 4)"))(
    lambda spark, d: _ids(spark, d, T_EMPTY))

# -- F14-F17 (the value 'pk_1' holds an underscore that must match literally) -------------
T_TEXT = AND(OR(leaf("contains", "email", "BUILDING"), leaf("starts_with", "primary_key", "pk_1"),
                leaf("ends_with", "f2", "07")),
             leaf("not_contains", "f6", "as"))
register("filter_text", _sql_ids(
    "(email ILIKE '%BUILDING%' ESCAPE '\\' OR primary_key ILIKE 'pk\\_1%' ESCAPE '\\' "
    "OR f2 ILIKE '%07' ESCAPE '\\') AND (f6 IS NULL OR f6 NOT ILIKE '%as%' ESCAPE '\\')"))(
    lambda spark, d: _ids(spark, d, T_TEXT))

# -- F18-F19 --------------------------------------------------------------------------------------
T_NULLS = OR(leaf("is_null", "f6"), AND(leaf("not_null", "email"), leaf("is_null", "f31")))
register("filter_null_ops", _sql_ids("f6 IS NULL OR (email IS NOT NULL AND f31 IS NULL)"))(
    lambda spark, d: _ids(spark, d, T_NULLS))

# -- F1-F3, D1 ---------------------------------------------------------------------------------------
T_NESTED = OR(AND(leaf("eq", "f30", "BUILDING"), OR(leaf("gt", "f31", 60), leaf("is_null", "f6"))),
              AND(leaf("eq", "f30", "MACHINERY"), NOT(OR(leaf("eq", "f6", "AFRICA"), leaf("lt", "f31", 40)))),
              NOT(AND(leaf("neq", "email_status", 3), OR(leaf("neq", "sms_status", 2), leaf("is_null", "f6")))))
register("filter_nested_tree", _sql_ids(
    "(f30 = 'BUILDING' AND (f31 > 60 OR f6 IS NULL)) OR (f30 = 'MACHINERY' AND NOT (f6 = 'AFRICA' OR f31 < 40)) "
    "OR NOT (email_status <> 3 AND (sms_status <> 2 OR f6 IS NULL))"))(
    lambda spark, d: _ids(spark, d, T_NESTED))

T_NOT_NULL_LOGIC = NOT(AND(leaf("eq", "f30", "BUILDING"), leaf("eq", "f6", "ASIA")))
register("filter_not_null_logic", _sql_ids("NOT (f30 = 'BUILDING' AND f6 = 'ASIA')"))(
    lambda spark, d: _ids(spark, d, T_NOT_NULL_LOGIC))

# -- F20, P18: text column compared as a date; malformed text is unknown -------------------
T_DATE = AND(leaf("gt", "f7", "2016-06-30", datatype="date"),
             leaf("between", "f7", values=["2016-01-01", "2020-12-31"], datatype="date"),
             leaf("not_in", "f7", values=["2017-03-01"], datatype="date"))
register("filter_typed_date", _sql_ids(
    "TRY_CAST(f7 AS DATE) > DATE '2016-06-30' AND TRY_CAST(f7 AS DATE) BETWEEN DATE '2016-01-01' AND DATE '2020-12-31' "
    "AND (TRY_CAST(f7 AS DATE) IS NULL OR TRY_CAST(f7 AS DATE) NOT IN (DATE '2017-03-01'))"))(
    lambda spark, d: _ids(spark, d, T_DATE))

# -- F27 ------------------------------------------------------------------------------------------------
FLAT = {"values": {"account_id": 3, "email_status": 1, "f30": ["BUILDING", "MACHINERY"],
                   "f31": {"op": "gte", "value": 40}}}
register("filter_flat_values", _sql_ids("account_id = 3 AND email_status = 1 AND f30 IN ('BUILDING', 'MACHINERY') AND f31 >= 40"))(
    lambda spark, d: _ids(spark, d, FLAT))

# -- F24 ---------------------------------------------------------------------------------------------------
RAW = AND({"op": "raw", "sql": "f31 > 40 AND lower(f30) = 'machinery'"}, leaf("eq", "email_status", 1))
register("filter_raw", _sql_ids("(f31 > 40 AND lower(f30) = 'machinery') AND email_status = 1"))(
    lambda spark, d: _ids(spark, d, RAW))


# -- F28-F32: rules ------------------------------------------------------------------------------------------
def rule(t, op, *opts):
    return {"type": t, "operator": op, "options": list(opts)}


R_STATUS = [[rule("status", "status_unsubscribed", "email")],
            [rule("status", "status_equals", "sms", 3), rule("status", "status_active", "email")],
            [rule("status", "status_manually_suppressed", "sms")]]
register("rules_status", _sql_ids("(email_status = 2) OR (sms_status = 3 AND email_status = 1) OR (sms_status = 5)"))(
    lambda spark, d: _ids(spark, d, R_STATUS))

R_TEXT = [[rule("attributes", "text_attr_contains", "f2", "0001"), rule("attributes", "text_attr_not_equals", "f30", "HOUSEHOLD")],
          [rule("attributes", "text_attr_is_empty", "f6"), rule("attributes", "text_attr_in", "f18", "NATION_5", "NATION_7", "NATION_9")],
          [rule("attributes", "text_attr_starts_with", "f2", "customer#0000011"),
           rule("attributes", "text_attr_not_in", "f6", "ASIA")],
          [rule("attributes", "text_attr_ends_with", "email", ".COM"), rule("attributes", "text_attr_not_contains", "f6", "r"),
           rule("attributes", "text_attr_is_not_empty", "f31")]]
register("rules_text", _sql_ids(
    "(f2 ILIKE '%0001%' ESCAPE '\\' AND f30 <> 'HOUSEHOLD') OR (f6 IS NULL AND f18 IN ('NATION_5', 'NATION_7', 'NATION_9')) "
    "OR (f2 ILIKE 'customer#0000011%' ESCAPE '\\' AND (f6 IS NULL OR f6 NOT IN ('ASIA'))) "
    "OR (email ILIKE '%.COM' ESCAPE '\\' AND (f6 IS NULL OR f6 NOT ILIKE '%r%' ESCAPE '\\') AND f31 IS NOT NULL)"))(
    lambda spark, d: _ids(spark, d, R_TEXT))

R_NUMBER = [[rule("attributes", "number_attr_between", "f31", "30", "35"), rule("attributes", "number_attr_not_equals", "sms_status", 1)],
            [rule("attributes", "number_attr_not_between", "f31", 26, 68), rule("attributes", "number_attr_gte", "created_at", "1600050000")],
            [rule("attributes", "number_attr_lt", "f31", 27), rule("attributes", "number_attr_lte", "email_status", 2)],
            [rule("attributes", "number_attr_equals", "f31", 50), rule("attributes", "number_attr_gt", "import_source", "4")]]
register("rules_number", _sql_ids(
    "(f31 BETWEEN 30 AND 35 AND sms_status <> 1) OR ((f31 IS NULL OR f31 NOT BETWEEN 26 AND 68) AND created_at >= 1600050000) "
    "OR (f31 < 27 AND email_status <= 2) OR (f31 = 50 AND import_source > 4)"))(
    lambda spark, d: _ids(spark, d, R_NUMBER))

# a number rule on a text column: text that is no number is unknown
R_NUMBER_TEXT = [[rule("attributes", "number_attr_gt", "f7", 5)], [rule("attributes", "number_attr_lte", "mobile", 9000000050)],
                 [rule("attributes", "number_attr_not_between", "f18", 1, 2), rule("attributes", "number_attr_equals", "f31", 30)]]
register("rules_number_text", _sql_ids(
    "(TRY_CAST(f7 AS DECIMAL(38,10)) > 5) OR (TRY_CAST(mobile AS DECIMAL(38,10)) <= 9000000050) "
    "OR ((TRY_CAST(f18 AS DECIMAL(38,10)) IS NULL OR TRY_CAST(f18 AS DECIMAL(38,10)) NOT BETWEEN 1 AND 2) AND f31 = 30)"))(
    lambda spark, d: _ids(spark, d, R_NUMBER_TEXT))

R_DATE = [[rule("attributes", "date_attr_between", "f7", "2016-01-01", "2016-12-31")],
          [rule("attributes", "date_attr_gte", "f7", "2022-06-01"), rule("attributes", "date_attr_lt", "f7", "2022-09-01")],
          [rule("attributes", "date_attr_equals", "f7", "2018-05-05")],
          [rule("attributes", "date_attr_gt", "f7", "2023-01-01"), rule("attributes", "date_attr_lte", "f7", "2023-01-10")]]
register("rules_date", _sql_ids(
    "(TRY_CAST(f7 AS DATE) BETWEEN DATE '2016-01-01' AND DATE '2016-12-31') "
    "OR (TRY_CAST(f7 AS DATE) >= DATE '2022-06-01' AND TRY_CAST(f7 AS DATE) < DATE '2022-09-01') "
    "OR (TRY_CAST(f7 AS DATE) = DATE '2018-05-05') "
    "OR (TRY_CAST(f7 AS DATE) > DATE '2023-01-01' AND TRY_CAST(f7 AS DATE) <= DATE '2023-01-10')"))(
    lambda spark, d: _ids(spark, d, R_DATE))

SEGMENT_DEFS = {
    "101": [[rule("attributes", "text_attr_equals", "f30", "BUILDING"), rule("attributes", "number_attr_lt", "f31", 45)]],
    "102": [[rule("attributes", "number_attr_gt", "f31", 60), rule("attributes", "text_attr_equals", "f30", "BUILDING")]],
    "103": [[rule("attributes", "number_attr_gt", "f31", 65), rule("attributes", "text_attr_equals", "f30", "BUILDING")],
            [rule("attributes", "text_attr_equals", "f30", "BUILDING"), rule("attributes", "text_attr_equals", "f6", "ASIA")]],
    "104": [[rule("segments", "in_any_segments", 101, 102), rule("attributes", "text_attr_equals", "f6", "EUROPE")]],
}
S101 = "(f30 = 'BUILDING' AND f31 < 45)"
S102 = "(f31 > 60 AND f30 = 'BUILDING')"
S103 = "((f31 > 65 AND f30 = 'BUILDING') OR (f30 = 'BUILDING' AND f6 = 'ASIA'))"
S104 = f"(({S101} OR {S102}) AND f6 = 'EUROPE')"
R_SEGMENTS = [[rule("segments", "in_any_segments", 101, 102), rule("segments", "out_of_any_segments", 103)],
              [rule("segments", "in_all_segments", 103, 104)],
              [rule("segments", "out_of_all_segments", 101, 103), rule("attributes", "text_attr_equals", "f30", "AUTOMOBILE"),
               rule("attributes", "number_attr_gt", "f31", 66)],
              [rule("segments", "out_of_any_segments", 104), rule("attributes", "text_attr_equals", "f2", "Customer#000000042")]]
register("rules_segments_any_all_out", _sql_ids(
    f"(({S101} OR {S102}) AND NOT {S103}) OR ({S103} AND {S104}) "
    f"OR (NOT ({S101} AND {S103}) AND f30 = 'AUTOMOBILE' AND f31 > 66) OR (NOT {S104} AND f2 = 'Customer#000000042')"))(
    lambda spark, d: _ids(spark, d, R_SEGMENTS, segment_defs=SEGMENT_DEFS))

R_RECENCY = [[rule("stats", "stats_email_campaigns_sent", 5, "days")],
             [rule("stats", "stats_sms_campaigns_not_sent", 2, "hours"), rule("status", "status_active", "sms")],
             [rule("stats", "stats_email_campaigns_not_sent", 7, "days"), rule("stats", "stats_sms_campaigns_sent", 300, "minutes")]]
_E = f"{AS_OF_EPOCH}"
register("rules_recency", _sql_ids(
    f"(last_emailed IS NOT NULL AND last_emailed > 0 AND last_emailed >= ({_E} - 432000)) "
    f"OR ((last_sms IS NULL OR last_sms = 0 OR last_sms < ({_E} - 7200)) AND sms_status = 1) "
    f"OR ((last_emailed IS NULL OR last_emailed = 0 OR last_emailed < ({_E} - 604800)) "
    f"AND (last_sms IS NOT NULL AND last_sms > 0 AND last_sms >= ({_E} - 18000)))"))(
    lambda spark, d: _ids(spark, d, R_RECENCY, as_of_epoch=AS_OF_EPOCH))


# -- J1-J3, F34 -----------------------------------------------------------------------------------------------
def _block_q(kind):
    def run(spark, sf_dir):
        df, _ = _contacts(spark, sf_dir)
        blocks = block_file_df(spark, sf_dir)
        base = scope(df).select("account_id", "id", "f2")
        if kind == "semi":
            return block_semi(base, blocks, [56]).select("account_id", "id")
        if kind == "anti":
            return block_anti(base, blocks, [57]).select("account_id", "id")
        flagged = add_block_flags(base, blocks, [(56,), (57,), (56, 57)])
        return flagged.select("account_id", "id",
                              *[F.col(flag_name(s)).cast("int").alias(n) for s, n in
                                (((56,), "in56"), ((57,), "in57"), ((56, 57), "in_any"))])
    return run


_EX = "EXISTS (SELECT 1 FROM block_file_data b WHERE b.block_file_id IN ({ids}) AND b.unique_identifier = c.f2)"
register("block_semi", f"{WITH_BLOCKS}\nSELECT account_id, id FROM contact c WHERE is_deleted = 0 AND {_EX.format(ids='56')}")(
    _block_q("semi"))
register("block_anti", f"{WITH_BLOCKS}\nSELECT account_id, id FROM contact c WHERE is_deleted = 0 AND NOT {_EX.format(ids='57')}")(
    _block_q("anti"))
register("block_flags", f"""{WITH_BLOCKS}
SELECT account_id, id, CAST({_EX.format(ids='56')} AS INTEGER) AS in56,
       CAST({_EX.format(ids='57')} AS INTEGER) AS in57, CAST({_EX.format(ids='56, 57')} AS INTEGER) AS in_any
FROM contact c WHERE is_deleted = 0""")(_block_q("flags"))

# -- A2: segment statistics per account -----------------------------------------------------------------------
T_SEGMENT = AND(leaf("eq", "f30", "BUILDING"), OR(leaf("is_null", "f6"), leaf("not_in", "f6", values=["ASIA", "EUROPE"])))
def _status_sql() -> str:
    names = ["email_active", "email_unsubscribed", "email_bounced", "email_marked_spam",
             "email_manually_suppressed", "email_unconfirmed"]
    parts = [f"CAST(SUM(CASE WHEN email_status = {i + 1} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
             for i, n in enumerate(names)]
    parts.append("CAST(SUM(CASE WHEN email_status = 1 AND sms_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sms_active")
    parts.append("CAST(SUM(CASE WHEN email_status = 1 AND sms_status = 5 THEN 1 ELSE 0 END) AS BIGINT) AS sms_manually_suppressed")
    return ",\n  ".join(parts)


@register("segment_stats", f"""{WITH_CONTACT}
SELECT account_id, CAST(SUM(CASE WHEN email_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cnt,
  {_status_sql()},
  CAST(SUM(CASE WHEN email_status IN (2, 3, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS email_all_suppressed
FROM contact WHERE is_deleted = 0 AND f30 = 'BUILDING' AND (f6 IS NULL OR f6 NOT IN ('ASIA', 'EUROPE'))
GROUP BY account_id""")
def q_segment_stats(spark, sf_dir):
    df, cat = _contacts(spark, sf_dir)
    comp_df, comp = prepare(scope(df), [T_SEGMENT], cat)
    return segment_stats(comp_df, comp.compile(T_SEGMENT), by="account_id")


# -- A3-A7, J3: campaign statistics (flagship) -------------------------------------------------------------------
INCLUDE = [[rule("segments", "in_any_segments", 101, 102)], [rule("block_files", "in_blockfiles", 56)]]
EXCLUDE = [[rule("segments", "in_any_segments", 103)], [rule("block_files", "in_blockfiles", 57)]]
_INC = f"(({S101} OR {S102}) OR {_EX.format(ids='56')})"
_EXC = f"({S103} OR {_EX.format(ids='57')})"
_MATCH = f"(email_status = 1 AND {_INC} AND NOT {_EXC})"
CAMPAIGN_STATS_SQL = f"""{WITH_BLOCKS}
SELECT account_id,
  CAST(COUNT(DISTINCT CASE WHEN {_MATCH} THEN NULLIF(TRIM(email), '') END) AS BIGINT) AS cnt,
  CAST(SUM(CASE WHEN {_MATCH} AND NULLIF(TRIM(email), '') IS NOT NULL THEN 1 ELSE 0 END)
       - COUNT(DISTINCT CASE WHEN {_MATCH} THEN NULLIF(TRIM(email), '') END) AS BIGINT) AS duplicate_count,
  CAST(SUM(CASE WHEN email_status = 1 AND {_INC} THEN 1 ELSE 0 END) AS BIGINT) AS include_count,
  CAST(SUM(CASE WHEN email_status = 1 AND {_INC} AND {_EXC} THEN 1 ELSE 0 END) AS BIGINT) AS exclude_count,
  {_status_sql()},
  CAST(SUM(CASE WHEN email_status IN (2, 3, 4, 5) AND {_INC} THEN 1 ELSE 0 END) AS BIGINT) AS email_all_suppressed
FROM contact c WHERE is_deleted = 0
GROUP BY account_id"""


@register("campaign_stats", CAMPAIGN_STATS_SQL)
def q_campaign_stats(spark, sf_dir):
    df, cat = _contacts(spark, sf_dir)
    return campaign_report(df, INCLUDE, EXCLUDE, cat, segment_defs=SEGMENT_DEFS,
                           blocks=block_file_df(spark, sf_dir), by="account_id")


CAMPAIGN_RULES = [
    [rule("status", "status_active", "email"), rule("segments", "in_any_segments", 101, 102),
     rule("segments", "out_of_any_segments", 103), rule("block_files", "out_of_any_blockfiles", 57),
     rule("stats", "stats_email_campaigns_not_sent", 2, "days")],
    [rule("status", "status_active", "email"), rule("block_files", "in_blockfiles", 56),
     rule("segments", "out_of_any_segments", 103), rule("block_files", "out_of_any_blockfiles", 57),
     rule("stats", "stats_email_campaigns_not_sent", 2, "days")],
]
_NOT_SENT = f"(last_emailed IS NULL OR last_emailed = 0 OR last_emailed < ({_E} - 172800))"
register("campaign_audience", f"""{WITH_BLOCKS}
SELECT account_id, id FROM contact c WHERE is_deleted = 0 AND (
  (email_status = 1 AND ({S101} OR {S102}) AND NOT {S103} AND NOT {_EX.format(ids='57')} AND {_NOT_SENT})
  OR (email_status = 1 AND {_EX.format(ids='56')} AND NOT {S103} AND NOT {_EX.format(ids='57')} AND {_NOT_SENT}))""")(
    lambda spark, d: _ids(spark, d, CAMPAIGN_RULES, segment_defs=SEGMENT_DEFS, blocks=block_file_df(spark, d),
                          as_of_epoch=AS_OF_EPOCH))


# -- A1, F25-F26: count of a segment per account --------------------------------------------------------------
@register("segment_count", f"""{WITH_CONTACT}
SELECT account_id, CAST(COUNT(*) AS BIGINT) AS cnt FROM contact
WHERE is_deleted = 0 AND email_status = 1 AND f31 >= 40 GROUP BY account_id""")
def q_segment_count(spark, sf_dir):
    df, cat = _contacts(spark, sf_dir)
    tree = to_tree({"values": {"email_status": 1, "f31": {"op": "gte", "value": 40}}}, cat)
    return audience(df, tree, cat).groupBy("account_id").agg(F.count(F.lit(1)).alias("cnt"))


# -- A10, A11 ---------------------------------------------------------------------------------------------------------
@register("count_filter", f"""{WITH_CONTACT}
SELECT account_id, CAST(count(*) FILTER (WHERE email_status = 1 AND f31 > 40) AS BIGINT) AS cnt,
       CAST(count(*) AS BIGINT) AS total
FROM contact GROUP BY account_id""")
def q_count_filter(spark, sf_dir):
    df, _ = _contacts(spark, sf_dir)
    return count_where(df, (F.col("email_status") == 1) & (F.col("f31") > 40), by="account_id")


@register("distinct_accounts", f"""{WITH_CONTACT}
SELECT CAST(count(DISTINCT account_id) AS BIGINT) AS distinct_accounts FROM contact""")
def q_distinct_accounts(spark, sf_dir):
    df, _ = _contacts(spark, sf_dir)
    return distinct_count(df, "account_id", "distinct_accounts")


# -- A12: preview = count + first rows per account --------------------------------------------------------------------
@register("segment_preview", f"""{WITH_CONTACT},
m AS (SELECT * FROM contact WHERE f30 = 'BUILDING' AND f31 > 30),
cnts AS (SELECT account_id, CAST(count(*) AS BIGINT) AS cnt FROM m GROUP BY account_id),
ranked AS (SELECT account_id, id, email, CAST(email_status AS INTEGER) AS email_status,
                  ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY id) AS sample_rank FROM m)
SELECT r.account_id, r.id, r.email, r.email_status, r.sample_rank, c.cnt
FROM ranked r JOIN cnts c USING (account_id) WHERE r.sample_rank <= 5""")
def q_segment_preview(spark, sf_dir):
    df, cat = _contacts(spark, sf_dir)
    tree = AND(leaf("eq", "f30", "BUILDING"), leaf("gt", "f31", 30))
    m = audience(df, tree, cat, deleted="include")
    counts, sample = preview(m, n=5, columns=["id", "email", "email_status"])
    return sample.withColumn("email_status", F.col("email_status").cast("int")).join(counts, "account_id")
