"""Audience books: bitmaps that days of changes keep equal to the plain report."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.operators.stats import campaign_stats
from cohorta.plans.audience_book import REPORT, Audience, AudienceBook
from cohorta.sources.readers import conform
from cohorta.sources.warehouse import Warehouse



def audiences():
    return {"oslo": Audience(F.col("f7") == "Oslo"),
            "young": Audience(F.col("campaign_sent_cnt") < 40, F.col("f6") == "x"),
            "none": Audience(F.lit(False))}


DAY = [dt.date(2024, 1, d) for d in range(1, 6)]


def _rows(spark, rng, n, seq, deletes=True):
    """Random changes of 150 contacts in three accounts, one of them holding most, with shared and blank e-mails."""
    out = []
    for k in range(n):
        mail = rng.choice([None, " ", *[f"m{rng.randrange(90)}@x.test" for _ in range(6)]])
        out.append((rng.choice([1, 1, 1, 2, 3]), rng.randrange(150), mail, rng.choice([1, 1, 1, 2, 3, None]),
                    rng.choice([1, 5, None]), rng.choice(["Oslo", "Rome", None]), rng.choice([20, 50, None]),
                    rng.choice(["x", "y", None]), "delete" if deletes and rng.random() < 0.25 else "upsert",
                    dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(4000)), seq * 10000 + k))
    df = spark.createDataFrame(out, "account_id bigint, id bigint, email string, email_status int, sms_status int, f7 string, "
                                    "campaign_sent_cnt int, f6 string, _op string, _ts timestamp, _seq bigint")
    return conform(df, S.with_change_columns(S.CONTACT))


def _plain(wh, until=None):
    out = set()
    for name, a in audiences().items():
        stats = campaign_stats(wh.table("contact", until=until), a.include, a.exclude, by="account_id")
        out |= {(name, *r) for r in stats.select(*REPORT[1:]).collect()}
    return out


def _told(report):
    return {tuple(r) for r in report.collect()}


def _reach(wh, names):
    """Distinct matching e-mails in any and in all audiences, by sets."""
    found: dict = {}
    for name in names:
        a = audiences()[name]
        keep = F.lit(True) if a.exclude is None else ~a.exclude
        rows = wh.contact().filter((F.col("email_status") == 1) & a.include & keep).select("account_id", F.trim("email"))
        for account, mail in rows.collect():
            if mail:
                found.setdefault(account, {}).setdefault(name, set()).add(mail)
    empty: set = set()
    return {(account, len(set().union(*of.values())), len(set.intersection(*[of.get(n, empty) for n in names])))
            for account, of in found.items()}


def test_days_of_changes(spark, tmpdir_path):
    rng = random.Random(3)
    wh = Warehouse(spark, tmpdir_path + "/wh")
    wh.write_snapshot("contact", _rows(spark, rng, 300, 0, deletes=False))
    book = AudienceBook(wh, "b", audiences())
    assert book.report().count() == 0
    with pytest.raises(ValueError, match="build the book first"):
        book.advance(DAY[1])
    book.build(DAY[0])
    assert _told(book.report()) == _plain(wh)
    told = {}
    for i in (1, 2):
        wh.write_delta("contact", _rows(spark, rng, 120, i), DAY[i])
        book.advance(DAY[i])
        told[i] = _told(book.report())
        assert told[i] == _plain(wh)
    with pytest.raises(ValueError, match="is not after"):
        book.advance(DAY[2])
    reach = _reach(wh, ["oslo", "young"])
    assert _told(book.reach(["oslo", "young"])) == reach
    assert _told(book.report(DAY[1])) == told[1]                # an earlier day, from the same tables
    book.fold()
    assert _told(book.report()) == told[2]
    assert _told(book.reach(["young", "oslo"])) == reach
    # a report reads the folded version only, and no contact
    assert all("/audience_book/" in f for f in book.report().inputFiles())
    plan = book.report()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all(">= 4)" in line and "<= 4)" in line for line in scans)
    # all contacts of account 2 go; two days at once
    gone = wh.contact().filter("account_id = 2").withColumns(
        {"_op": F.lit("delete"), "_ts": F.lit(dt.datetime(2025, 1, 1)), "_seq": F.lit(1)})
    wh.write_delta("contact", conform(gone, S.with_change_columns(S.CONTACT)), DAY[3])
    wh.write_delta("contact", _rows(spark, rng, 40, 5).filter("account_id <> 2"), DAY[4])
    book.advance(DAY[4])
    assert _told(book.report()) == _plain(wh)
    assert all(r.account_id != 2 for r in book.report().collect())


def test_a_stopped_day_is_not_seen_and_can_be_repeated(spark, tmpdir_path, monkeypatch):
    rng = random.Random(4)
    wh = Warehouse(spark, tmpdir_path + "/wh")
    wh.write_snapshot("contact", _rows(spark, rng, 200, 0, deletes=False))
    book = AudienceBook(wh, "b", audiences())
    book.build(DAY[0])
    before = _told(book.report())
    wh.write_delta("contact", _rows(spark, rng, 100, 1), DAY[1])

    def stop(_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(book.commits, "add", stop)
        with pytest.raises(RuntimeError, match="lost"):
            book.advance(DAY[1])
    assert _told(book.report()) == before
    book.advance(DAY[1])
    assert _told(book.report()) == _plain(wh)


def test_no_contacts(spark, tmpdir_path):
    book = AudienceBook(Warehouse(spark, tmpdir_path + "/wh"), "b", audiences())
    book.build(DAY[0])
    book.advance(DAY[1])                                        # a day without a delta
    book.fold()
    assert book.report().count() == 0 and book.reach(["oslo"]).count() == 0
