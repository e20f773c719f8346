"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from cohorta.operators.blocks import add_block_flags, block_anti, block_semi, flag_name, may_be_listed
from cohorta.operators.campaigns import evaluate_segments, segment_membership
from cohorta.operators.merge import merge_latest
from cohorta.operators.paging import page
from tests.fixture_rows import block_files, block_sql, duck, lake_contacts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_block_joins(spark):
    c = lake_contacts(spark)
    b = block_files(spark)
    sets = [(21,), (22,), (21, 22)]
    flags = add_block_flags(c, b, sets)
    con = duck()
    want = con.execute(f"select id, coalesce({block_sql(21)}, false), coalesce({block_sql(22)}, false), "
                       f"coalesce({block_sql(21)} or {block_sql(22)}, false) from c").fetchall()
    assert _rows(flags, "id", *[flag_name(s) for s in sets]) == sorted(want)
    # one join and one reduction of the block table for all sets, no job while planning
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Aggregate") == 1
    inside = {r[0] for r in want if r[1]}
    assert {r.id for r in block_semi(c, b, [21]).collect()} == inside
    anti = {r.id for r in block_anti(c, b, [21]).collect()}
    assert anti == {r[0] for r in want} - inside and any(x.f2 is None for x in block_anti(c, b, [21]).collect())


def test_block_join_reads_what_it_needs(spark, tmpdir_path):
    lake_contacts(spark).write.parquet(tmpdir_path + "/c")
    c = spark.read.parquet(tmpdir_path + "/c")
    plan = block_semi(c, block_files(spark), [21]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert all("email" not in line and "mobile" not in line for line in plan.splitlines() if "ReadSchema" in line)


def _shuffled_rows(df):
    """Rows written to the exchanges of the executed plan, most first."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sorted(out, reverse=True)


def test_block_semi_moves_contacts_that_may_match(spark, tmpdir_path):
    spark.range(30000).select(F.lit(5).alias("account_id"), "id",
                              F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), "id")).alias("f2")).write.parquet(tmpdir_path + "/c")
    spark.range(400).select(F.lit(21).cast("long").alias("block_file_id"),
                            F.concat(F.lit("k"), F.col("id") % 200 * 7).alias("unique_identifier")).write.parquet(tmpdir_path + "/b")
    c, b = spark.read.parquet(tmpdir_path + "/c"), spark.read.parquet(tmpdir_path + "/b")
    broadcast = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in broadcast}
    try:
        for k in broadcast:
            spark.conf.set(k, "-1")
        listed = block_semi(c, b, [21]).select("id")
        assert {r.id for r in listed.collect()} == {i * 7 for i in range(200) if i * 7 % 4}
        moved = _shuffled_rows(listed)
        assert moved and moved[0] < 1000                 # of 22,500 contacts with a key; without the bitmap all of them
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert block_semi(c, b, [99]).count() == 0
    # a bitmap smaller than the list lets others pass, the join decides
    keys = b.select("unique_identifier")
    assert c.filter(may_be_listed(F.col("f2"), keys, cells=64)).count() >= 150


def test_merge_plans_limit_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("_seq"),
                                  F.lit("upsert").alias("_op"), F.current_timestamp().alias("_ts"))
    plan = _plan(merge_latest(df, "k"))
    assert "WindowGroupLimit" in plan
    # the partial limit sits below the exchange
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_page_per_group_is_top_k(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    out = page(df, "id", "DESC", limit=2, offset=1, by="g")
    assert "WindowGroupLimit" in _plan(out)
    assert _rows(out, "g", "id", "page_rank") == sorted([(0, 96, 1), (0, 93, 2), (1, 94, 1), (1, 91, 2),
                                                         (2, 95, 1), (2, 92, 2)])


def test_segments_one_scan(spark):
    c = lake_contacts(spark)
    compiled = {"oslo": F.col("f18") == "Oslo", "young": F.col("f31") < 40, "none": F.lit(False)}
    oslo, young = duck().execute("select count(*) filter (f18 = 'Oslo'), count(*) filter (f31 < 40) from c").fetchone()
    counts = evaluate_segments(c, compiled, by=("is_contact",))
    assert {(r.segment_id, r.cnt) for r in counts.collect()} == {("oslo", oslo), ("young", young), ("none", 0)}
    members = segment_membership(c, compiled)
    assert members.count() == oslo + young
    assert "Generate" in _plan(members) and "Exchange" not in _plan(members)


def test_segments_stay_with_their_account(spark):
    c = lake_contacts(spark)
    compiled, owners = {"a": F.col("f31") < 40, "b": F.col("f31") < 40}, {"a": 5, "b": 6}
    n = dict(duck().execute("select account_id, count(*) from c where f31 < 40 group by 1").fetchall())
    got = {(r.account_id, r.segment_id, r.cnt) for r in evaluate_segments(c, compiled, owners=owners).collect()}
    assert got == {(5, "a", n[5]), (6, "b", n[6])}
    assert segment_membership(c, compiled, owners=owners).count() == n[5] + n[6]


def test_ids_are_numbered_by_many_tasks(spark):
    from cohorta.operators.stats import assign_ids
    new = spark.range(2000).select((F.col("id") % 3).alias("account_id"), F.col("id").alias("created_at"), F.lit("n").alias("name"))
    have = spark.createDataFrame([(0, 10), (0, 12), (1, 3)], "account_id bigint, id bigint")
    got = sorted((r.account_id, r.created_at, r.id) for r in assign_ids(new.repartition(5), have).collect())
    start = {0: 12, 1: 3, 2: 0}
    assert got == sorted((k % 3, k, start[k % 3] + k // 3 + 1) for k in range(2000))


def test_limits_raise(spark):
    import pytest

    from cohorta.operators.paging import keyset_page
    with pytest.raises(ValueError, match="0..100"):
        keyset_page(spark.range(5), limit=101)
    assert keyset_page(spark.range(500), limit=300, max_limit=300).count() == 300
