import datetime as dt

from pyspark.sql import functions as F

from cohorta.operators.merge import merge_latest, union_by_name

T0 = dt.datetime(2024, 1, 1)


def ts(h):
    return T0 + dt.timedelta(hours=h)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _mk(spark, rows, cols="account_id bigint, id bigint, v string, _op string, _ts timestamp, _seq bigint"):
    return spark.createDataFrame(rows, cols)


def test_latest_wins_and_ties(spark):
    df = _mk(spark, [
        (1, 1, "old", "upsert", ts(0), 1), (1, 1, "new", "upsert", ts(1), 1),     # newer _ts wins
        (1, 2, "lo", "upsert", ts(0), 1), (1, 2, "hi", "upsert", ts(0), 2),       # equal _ts, higher _seq
        (2, 1, "other account", "upsert", ts(0), 1),                              # same id, other account
        (1, 3, "x", "upsert", None, 5), (1, 3, "y", "upsert", ts(0), 0),         # NULL _ts loses
    ])
    for method in ("window", "agg"):
        out = merge_latest(df, ("account_id", "id"), method=method)
        assert _rows(out) == [(1, 1, "new"), (1, 2, "hi"), (1, 3, "y"), (2, 1, "other account")]


def test_tombstones(spark):
    df = _mk(spark, [
        (1, 1, "a", "upsert", ts(0), 1), (1, 1, None, "delete", ts(1), 1),        # deleted
        (1, 2, "a", "upsert", ts(0), 1), (1, 2, None, "delete", ts(1), 1), (1, 2, "b", "upsert", ts(2), 1),  # back
        (1, 3, None, "delete", ts(0), 1),                                          # tombstone without base
        (1, 4, "a", "upsert", ts(0), 1), (1, 4, "n", None, ts(1), 1),              # NULL _op drops by default
    ])
    assert _rows(merge_latest(df, ("account_id", "id"))) == [(1, 2, "b")]
    kept = merge_latest(df, ("account_id", "id"), null_op_is_upsert=True)
    assert _rows(kept) == [(1, 2, "b"), (1, 4, "n")]


def test_exact_tie_is_deterministic(spark):
    rows = [(1, 1, v, "upsert", ts(0), 7) for v in ("p", "q", "r", "s")]
    a = _rows(merge_latest(_mk(spark, rows), ("account_id", "id")))
    b = _rows(merge_latest(_mk(spark, list(reversed(rows))).repartition(3), ("account_id", "id")))
    c = _rows(merge_latest(_mk(spark, rows), ("account_id", "id"), method="agg"))
    assert a == b == c and len(a) == 1


def test_schema_evolution_union(spark):
    snap = _mk(spark, [(1, 1, "a", "upsert", ts(0), 1), (1, 2, "b", "upsert", ts(0), 1)])
    delta = spark.createDataFrame([(1, 1, 9, "upsert", ts(1), 1)],
                                  "account_id bigint, id bigint, extra int, _op string, _ts timestamp, _seq bigint")
    out = merge_latest(union_by_name(snap, delta), ("account_id", "id"))
    assert _rows(out.select("id", "v", "extra")) == [(1, None, 9), (2, "b", None)]


def test_keep_change_columns_and_order_irrelevant(spark):
    rows = [(1, i % 5, f"v{i}", "upsert", ts(i % 3), i) for i in range(40)]
    a = merge_latest(_mk(spark, rows), ("account_id", "id"), keep_change_columns=True)
    b = merge_latest(_mk(spark, rows[::-1]).repartition(4), ("account_id", "id"), keep_change_columns=True)
    assert _rows(a) == _rows(b)
    assert a.columns == ["account_id", "id", "v", "_op", "_ts", "_seq"]
