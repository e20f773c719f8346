"""Replacing a partition: readers see the old rows or the new ones, whenever they come and wherever a run stops."""

import datetime as dt
import os

import pytest

from cohorta import schema as S
from cohorta.plans.compaction import compact
from cohorta.sources.readers import conform
from cohorta.sources.replacements import file_prefix
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import list_files

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, rows):
    df = spark.createDataFrame([(a, i, e, "upsert", T0, i) for a, i, e in rows],
                               "account_id bigint, id bigint, email string, _op string, _ts timestamp, _seq bigint")
    return conform(df, S.with_change_columns(S.CONTACT))


def _read(wh, account=None):
    return sorted(tuple(r) for r in wh.contact(account).select("account_id", "id", "email").collect())


OLD = [(1, 1, "old"), (1, 2, "old")]
OTHER = [(11, 1, "other"), (2, 1, "other")]
NEW = [(1, 2, "new"), (1, 3, "new")]


@pytest.fixture()
def wh(spark, tmpdir_path):
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh"))
    wh.write_snapshot("contact", _rows(spark, OLD + OTHER))
    return wh


def test_switch_is_seen_at_once_and_old_readers_go_on(spark, wh):
    before = wh.contact()
    wh.replace_partition("contact", _rows(spark, NEW), 1, keep_old=True)
    stored = len(list_files(spark, wh.path("contact", "snapshot")))
    assert _read(wh) == sorted(NEW + OTHER) and _read(wh, 1) == sorted(NEW)
    assert before.count() == len(OLD + OTHER)              # planned before the switch: the old state, whole
    assert wh.finish_replacements("contact") >= 1
    assert len(list_files(spark, wh.path("contact", "snapshot"))) < stored
    assert _read(wh) == sorted(NEW + OTHER)
    assert [m.state for m in wh.replacements("contact").marks()] == ["done"]
    assert wh.finish_replacements("contact") == 0


def test_stopped_before_the_switch(spark, wh):
    mark = wh.replacements("contact").begin(1)
    wh.add_replacement_rows("contact", _rows(spark, NEW + OTHER), mark)       # stored, never switched
    assert _read(wh) == sorted(OLD + OTHER)
    assert wh.finish_replacements("contact") >= 1                         # undone
    assert _read(wh) == sorted(OLD + OTHER) and wh.changes("contact").count() == 4
    wh.replace_partition("contact", _rows(spark, NEW), 1)
    assert _read(wh) == sorted(NEW + OTHER)


def test_stopped_between_switch_and_removal(spark, wh):
    wh.replace_partition("contact", _rows(spark, NEW), 1, keep_old=True)
    wh.replace_partition("contact", _rows(spark, OLD), 1, keep_old=True)   # completes the first one
    assert _read(wh) == sorted(OLD + OTHER)
    wh.replace_partition("contact", _rows(spark, []), 1, keep_old=True)    # empty
    assert _read(wh) == sorted(OTHER)
    assert compact(wh, "contact", full=True)["rows_written"] == 2
    assert _read(wh) == sorted(OTHER) and wh.changes("contact").count() == 2
    assert [m.number for m in wh.replacements("contact").marks()] == [3]   # numbers are not given twice
    wh.replace_partition("contact", _rows(spark, NEW), 1)
    assert _read(wh) == sorted(NEW + OTHER)


def test_compaction_after_a_switch_folds_only_what_is_read(spark, wh):
    wh.write_delta("contact", _rows(spark, [(1, 9, "delta")]), T0.date())
    wh.replace_partition("contact", _rows(spark, NEW), 1, keep_old=True)
    want = sorted([*NEW, (1, 9, "delta"), *OTHER])
    assert _read(wh) == want
    compact(wh, "contact")
    assert _read(wh) == want and list_files(spark, wh.path("contact", "delta")) == []


def test_replaced_while_a_reader_lists(spark, wh):
    other, plain = Warehouse(spark, wh.root), wh._read
    runs = []

    def listed(path, schema):
        rows = plain(path, schema)
        if path.endswith("snapshot") and not runs:
            runs.append(1)
            other.replace_partition("contact", _rows(spark, NEW), 1)       # the listed files are gone now
        return rows

    wh._read = listed
    assert _read(wh) == sorted(NEW + OTHER) and runs


def test_hidden_files_are_not_opened(spark, wh):
    wh.replace_partition("contact", _rows(spark, NEW), 1, keep_old=True)
    df = wh.changes("contact").select("id")
    plan = df._jdf.queryExecution()
    assert plan.toRdd().count() == 4
    leaves = plan.executedPlan().collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    hidden = [f for f in list_files(spark, wh.path("contact", "snapshot"))
              if "/account_id=1/" in f and "/" + file_prefix(1) not in f]
    assert hidden and read == len(list_files(spark, wh.path("contact", "snapshot"))) - len(hidden)
