"""Audiences and reports on the small lake against DuckDB SQL of the same meaning."""

import pytest
from pyspark.sql import functions as F

from cohorta.operators.audience import audience, campaign_report
from cohorta.operators.stats import scope, segment_stats
from cohorta.schema import sftp_catalog_for
from tests.fixture_rows import SEGMENT_SQL, SEGMENTS, block_files, block_sql, duck, lake_contacts, rule

AS_OF = 1_700_000_000
LIVE = "account_id = 6 and is_deleted = 0"
STATUS = ", ".join(f"count(*) filter (email_status = {k}) as {n}" for k, n in (
    (1, "email_active"), (2, "email_unsubscribed"), (3, "email_bounced"), (4, "email_marked_spam"),
    (5, "email_manually_suppressed"), (6, "email_unconfirmed")))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def sql_ids(where):
    return sorted(x for (x,) in duck().execute(f"select id from c where {LIVE} and ({where})").fetchall())


def sql_row(query):
    cur = duck().execute(query)
    return dict(zip([d[0] for d in cur.description], cur.fetchone()))


def test_segment_stats(spark):
    cond = F.col("f18").isin("Oslo", "Quito") & (F.col("f6").isNull() | (F.col("f6") != "east"))
    got = segment_stats(scope(lake_contacts(spark), 6), cond).first().asDict()
    want = sql_row(f"""select count(*) filter (email_status = 1) as cnt, {STATUS},
        count(*) filter (email_status = 1 and sms_status = 1) as sms_active,
        count(*) filter (email_status = 1 and sms_status = 5) as sms_manually_suppressed,
        count(*) filter (email_status in (2, 3, 4, 5)) as email_all_suppressed
        from c where {LIVE} and f18 in ('Oslo', 'Quito') and (f6 is null or f6 <> 'east')""")
    assert got == want and want["cnt"] > 0


def test_campaign_report(spark):
    c = lake_contacts(spark)
    include = [[rule("segments", "in_any_segments", 10, 11)], [rule("block_files", "in_blockfiles", 21)]]
    exclude = [[rule("segments", "in_any_segments", 12)], [rule("block_files", "in_blockfiles", 22)]]
    got = campaign_report(c, include, exclude, sftp_catalog_for(c), segment_defs=SEGMENTS, blocks=block_files(spark),
                          account_id=6).first().asDict()
    inc = f"({SEGMENT_SQL['10']} or {SEGMENT_SQL['11']} or {block_sql(21)})"
    exc = f"({SEGMENT_SQL['12']} or {block_sql(22)})"
    want = sql_row(f"""with t as (select *, email_status = 1 and {inc} and not {exc} as hit, {inc} as inc, {exc} as exc,
        nullif(trim(email), '') as k from c where {LIVE})
        select count(distinct k) filter (hit) as cnt, count(k) filter (hit) - count(distinct k) filter (hit) as duplicate_count,
        count(*) filter (email_status = 1 and inc) as include_count,
        count(*) filter (email_status = 1 and inc and exc) as exclude_count, {STATUS} from t""")
    assert {k: got[k] for k in want} == want
    # rows whose exclusion is unknown are in neither set
    assert want["include_count"] - want["exclude_count"] > 0


@pytest.mark.parametrize("spec,where", [
    ([rule("status", "status_active", "email"), rule("segments", "out_of_any_segments", 12),
      rule("block_files", "out_of_any_blockfiles", 21), rule("stats", "stats_email_campaigns_not_sent", 1, "hours")],
     f"email_status = 1 and not {SEGMENT_SQL['12']} and not {block_sql(21)} "
     f"and (last_emailed is null or last_emailed = 0 or last_emailed < {AS_OF - 3600})"),
    ([[rule("stats", "stats_email_campaigns_sent", 30, "minutes")], [rule("block_files", "in_any_blockfiles", 21, 22)]],
     f"(last_emailed > 0 and last_emailed >= {AS_OF - 1800}) or {block_sql(21)} or {block_sql(22)}"),
    ([rule("segments", "out_of_all_segments", 10, 11)], f"not ({SEGMENT_SQL['10']} and {SEGMENT_SQL['11']})"),
    ([rule("attributes", "number_attr_not_between", "f31", 10, 40), rule("attributes", "text_attr_not_contains", "f6", "OUT"),
      rule("attributes", "date_attr_gt", "f7", "2010-06-15")],
     "(f31 is null or f31 not between 10 and 40) and (f6 is null or f6 not ilike '%out%') and try_cast(f7 as date) > date '2010-06-15'"),
])
def test_rule_audiences(spark, spec, where):
    c = lake_contacts(spark)
    got = ids(audience(c, spec, sftp_catalog_for(c), segment_defs=SEGMENTS, blocks=block_files(spark), account_id=6,
                       as_of_epoch=AS_OF))
    assert got == sql_ids(where) and got


def leaf(op, name, value=None, values=None, datatype=None):
    out = {"op": op, "field": name}
    out |= {"value": value} if value is not None else {}
    out |= {"values": values} if values is not None else {}
    return out | ({"datatype": datatype} if datatype else {})


@pytest.mark.parametrize("tree,where", [
    (leaf("eq", "f30", "gold"), "f30 = 'gold'"), (leaf("neq", "f30", "gold"), "f30 <> 'gold'"),
    (leaf("gt", "id", 40), "id > 40"), (leaf("gte", "f31", 20), "f31 >= 20"),
    (leaf("lt", "f31", 9), "f31 < 9"), (leaf("lte", "f7", "2003-01-31", datatype="date"), "cast(f7 as date) <= date '2003-01-31'"),
    (leaf("contains", "email", "P1"), "email ilike '%p1%'"), (leaf("not_contains", "f6", "t"), "f6 is null or f6 not ilike '%t%'"),
    (leaf("starts_with", "primary_key", "key5"), "primary_key ilike 'key5%'"), (leaf("ends_with", "f2", "7"), "f2 ilike '%7'"),
    (leaf("in", "f18", values=["Quito", "Lagos"]), "f18 in ('Quito', 'Lagos')"),
    (leaf("not_in", "f18", values=["Quito"]), "f18 is null or f18 <> 'Quito'"),
    (leaf("between", "f31", values=[5, 30]), "f31 between 5 and 30"),
    (leaf("not_between", "f31", values=[5, 30]), "f31 is null or f31 not between 5 and 30"),
    (leaf("is_null", "f6"), "f6 is null"), (leaf("not_null", "mobile"), "mobile is not null"),
    ({"op": "not", "children": [{"op": "and", "children": [leaf("eq", "f6", "south"), leaf("gt", "f31", 12)]}]},
     "not (f6 = 'south' and f31 > 12)"),
    ({"op": "or", "children": [leaf("is_null", "f30"), {"op": "raw", "sql": "length(f2) > 6"}]}, "f30 is null or length(f2) > 6"),
])
def test_trees(spark, tree, where):
    c = lake_contacts(spark)
    assert ids(audience(c, tree, sftp_catalog_for(c), account_id=6)) == sql_ids(where)


def test_flat_values_scope(spark):
    c = lake_contacts(spark)
    got = ids(audience(c, {"values": {"account_id": 6, "f18": ["Oslo"], "f31": {"op": "lt", "value": 10}}}, sftp_catalog_for(c)))
    assert got == sql_ids("f18 = 'Oslo' and f31 < 10")
