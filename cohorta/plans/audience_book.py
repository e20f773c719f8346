"""Audience reports kept up to date by bitmaps (A3, A4).

An ``AudienceBook`` stores, for a set of named audiences, what
``campaign_stats`` counts, so that a report reads bitmaps and sums instead of
contacts, and a day's changes cost as much as the contacts that changed:

``keys``    a number for each e-mail of an account, given once
``refs``    how many contacts of an audience have a key now
``bits``    64 keys to a row: bit ``number % 64`` of word ``number / 64`` is
            set while the key has a contact in the audience
``counts``  changes of the row counts, to be summed

The words are longs in rows of their own, so a day writes only the words it
touches and all bit work is Spark's bitwise functions and aggregates.  A key
leaves its audience with its last contact, which ``refs`` tell without
reading other contacts.  Numbers are shared by the audiences of a book, so
the distinct e-mails of any or all of several audiences are counted by
``bit_or`` and ``bit_and``.

``build`` starts from all contacts up to a day, ``advance`` adds one day's
delta, ``fold`` writes the state anew as one version.  Each writes a version
and commits it at the end; a run that stops in between has done nothing.
``advance`` compares the contacts of the delta before and after it, so it
comes before the compaction that folds that day away; rows added later for a
day already taken are seen by ``build`` only.

Defined results: a blank or NULL e-mail is no key; an unknown test is handled
as in ``campaign_stats``; an account without live contacts has no row; a book
never built, or of no contacts, reports no rows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.functions.coerce import blank_to_null
from cohorta.operators.stats import EMAIL_STATUS_COLUMNS, SUPPRESSED_CODES, assign_ids
from cohorta.session import scratch_dir
from cohorta.sources.commits import Commit, Commits
from cohorta.sources.readers import empty_table, has_parquet
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import write_parquet

STATUS_COUNTS = (*[name for name, _ in EMAIL_STATUS_COLUMNS], "sms_active", "sms_manually_suppressed")
COUNTERS = ("rows", "matched", "include_count", "exclude_count", *STATUS_COUNTS, "email_all_suppressed")
REPORT = ("audience", "account_id", "cnt", "duplicate_count", "include_count", "exclude_count", *STATUS_COUNTS,
          "email_all_suppressed")
WORD_BITS = 64


def _schema(ddl: str) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(ddl).fields, T.StructField("version", T.IntegerType())])


STATE = {
    "keys": "account_id bigint, key string, number bigint",
    "refs": "audience string, account_id bigint, number bigint, n bigint",
    "bits": "audience string, account_id bigint, word bigint, bits bigint",
    "counts": "audience string, account_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS),
}


@dataclass(frozen=True)
class Audience:
    include: Column
    exclude: Column | None = None


class AudienceBook:
    def __init__(self, wh: Warehouse, name: str, audiences: dict[str, Audience]):
        if not audiences:
            raise ValueError("a book needs an audience")
        self.wh, self.spark, self.audiences = wh, wh.spark, dict(audiences)
        self.root = wh.path("audience_book", name)
        self.commits = Commits(wh.spark, self.root + "/commits")

    # -- stored state ----------------------------------------------------------
    def _state(self, table: str, commit: Commit | None) -> DataFrame:
        schema, path = _schema(STATE[table]), f"{self.root}/{table}"
        if commit is None or not has_parquet(self.spark, path):
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(path) \
            .filter(F.col("version").between(commit.base, commit.version))

    def _write(self, table: str, version: int, rows: DataFrame) -> DataFrame:
        """Write one version of a table and give it back as read; leftovers of a stopped run are replaced."""
        fields = [f for f in _schema(STATE[table]).fields if f.name != "version"]
        path = f"{self.root}/{table}/version={version}"
        write_parquet(rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]), path, "overwrite")
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    def _latest(self, table: str, commit: Commit | None, value: str, of: DataFrame | None = None) -> DataFrame:
        """The last value of each key of ``refs`` or ``bits``; ``of`` names the keys wanted."""
        key = [c for c in _schema(STATE[table]).fieldNames() if c not in (value, "version")]
        rows = self._state(table, commit)
        if of is not None:
            rows = rows.join(of.select(*key), key, "left_semi")
        return rows.groupBy(*key).agg(F.max_by(value, "version").alias(value))

    # -- contacts to changes -----------------------------------------------------
    def _signed(self, contacts: DataFrame, sign: int) -> DataFrame:
        """A row per contact and audience with the outcomes of the audience's tests."""
        tests = [F.struct(F.lit(name).alias("audience"), a.include.alias("inside"),
                          (F.lit(False) if a.exclude is None else a.exclude).alias("outside"))
                 for name, a in self.audiences.items()]
        return contacts.select("account_id", blank_to_null(F.col("email")).alias("key"), "email_status", "sms_status",
                               F.lit(sign).alias("_sign"), F.inline(F.array(*tests)))

    @staticmethod
    def _changes(rows: DataFrame) -> DataFrame:
        """Signed counts by audience, account and key."""
        status, sms = F.col("email_status"), F.col("sms_status")
        active, inside, outside = status == 1, F.col("inside"), F.col("outside")
        tests = {
            "rows": F.lit(True),
            "matched": active & inside & ~outside & F.col("key").isNotNull(),
            "include_count": active & inside,
            "exclude_count": active & inside & outside,
            **{name: status == code for name, code in EMAIL_STATUS_COLUMNS},
            "sms_active": active & (sms == 1),
            "sms_manually_suppressed": active & (sms == 5),
            "email_all_suppressed": status.isin(*SUPPRESSED_CODES) & inside,
        }
        return rows.groupBy("audience", "account_id", "key").agg(
            *[F.sum(F.when(tests[c], F.col("_sign")).otherwise(0)).alias(c) for c in COUNTERS])

    # -- jobs ----------------------------------------------------------------------
    def build(self, day: _dt.date) -> None:
        """Start the book anew from all contacts with the deltas up to ``day``."""
        last = self.commits.last()
        if last is not None and day < last.day:
            raise ValueError(f"the book is at {last.day}, it cannot go back to {day}")
        version = last.version + 1 if last else 1
        self._store(self._signed(self.wh.table("contact", until=day), 1), None, Commit(version, version, day))

    def advance(self, day: _dt.date) -> None:
        """Take in the delta of ``day``: contacts it names, as they were before it and are after it."""
        last = self.commits.last()
        if last is None or day <= last.day:
            raise ValueError(f"{day} is not after {last.day}" if last else "build the book first")
        ids = self.wh.delta_keys("contact", last.day, day)
        before = self.wh.table("contact", keys=ids, until=last.day)
        after = self.wh.table("contact", keys=ids, until=day)
        rows = self._signed(before, -1).unionByName(self._signed(after, 1))
        self._store(rows, last, Commit(last.version + 1, last.base, day))

    def _store(self, rows: DataFrame, last: Commit | None, new: Commit) -> None:
        stage = scratch_dir(self.spark, "audience-changes")
        self._changes(rows).write.mode("overwrite").parquet(stage)
        changes = self.spark.read.parquet(stage)
        some = reduce(lambda a, b: a | b, (F.col(c) != 0 for c in COUNTERS))
        counts = changes.groupBy("audience", "account_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        self._write("counts", new.version, counts.filter(some))

        moved = changes.filter("key IS NOT NULL AND matched <> 0").select("audience", "account_id", "key", "matched")
        known = self._state("keys", last).drop("version")
        unseen = moved.select("account_id", "key").distinct().join(known, ["account_id", "key"], "left_anti")
        fresh = self._write("keys", new.version, assign_ids(unseen, known, id_col="number", order=("key",)))

        numbered = moved.join(known.unionByName(fresh), ["account_id", "key"])
        refs = numbered.join(self._latest("refs", last, "n", numbered), ["audience", "account_id", "number"], "left") \
            .select("audience", "account_id", "number", (F.coalesce("n", F.lit(0)) + F.col("matched")).alias("n"))
        refs = self._write("refs", new.version, refs)

        bit = F.expr(f"shiftleft(1L, CAST(number % {WORD_BITS} AS INT))")
        words = refs.groupBy("audience", "account_id", F.expr(f"number DIV {WORD_BITS}").alias("word")).agg(
            F.bit_or(bit).alias("_touched"), F.bit_or(F.when(F.col("n") > 0, bit).otherwise(F.lit(0).cast("long"))).alias("_set"))
        key = ["audience", "account_id", "word"]
        kept = F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not("_touched"))
        self._write("bits", new.version, words.join(self._latest("bits", last, "bits", words), key, "left")
                    .select(*key, kept.bitwiseOR(F.col("_set")).alias("bits")))
        self.commits.add(new)

    def fold(self) -> None:
        """Write the state as one version, from the stored tables alone: later reports read no older one."""
        last = self.commits.last()
        if last is None:
            raise ValueError("build the book first")
        version = last.version + 1
        self._write("keys", version, self._state("keys", last))
        self._write("refs", version, self._latest("refs", last, "n").filter("n > 0"))
        self._write("bits", version, self._latest("bits", last, "bits").filter("bits <> 0"))
        self._write("counts", version, self._state("counts", last).groupBy("audience", "account_id")
                    .agg(*[F.sum(c).alias(c) for c in COUNTERS]))
        self.commits.add(Commit(version, version, last.day))

    # -- reports -----------------------------------------------------------------------
    def _at(self, day: _dt.date | None) -> Commit | None:
        return self.commits.last() if day is None else self.commits.as_of(day)

    def report(self, day: _dt.date | None = None) -> DataFrame:
        """``campaign_stats`` by audience and account, as of ``day`` or now."""
        at = self._at(day)
        counts = self._state("counts", at).groupBy("audience", "account_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        distinct = self._latest("bits", at, "bits").groupBy("audience", "account_id") \
            .agg(F.sum(F.bit_count("bits")).alias("cnt"))
        return counts.filter("rows > 0").join(distinct, ["audience", "account_id"], "left") \
            .withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long"))) \
            .withColumn("duplicate_count", F.col("matched") - F.col("cnt")).select(*REPORT)

    def reach(self, audiences: list[str], day: _dt.date | None = None) -> DataFrame:
        """Distinct e-mails of an account in any, and in all, of several audiences."""
        names = sorted(set(audiences))
        if not names or not set(names) <= set(self.audiences):
            raise ValueError(f"unknown audience in {audiences}")
        words = self._latest("bits", self._at(day), "bits").filter(F.col("audience").isin(names)) \
            .groupBy("account_id", "word").agg(F.bit_or("bits").alias("any"), F.bit_and("bits").alias("all"),
                                               F.count("*").alias("n"))
        both = F.when(F.col("n") == len(names), F.bit_count("all")).otherwise(0)
        return words.groupBy("account_id").agg(F.sum(F.bit_count("any")).alias("any_audience"),
                                               F.sum(both).alias("all_audiences")).filter("any_audience > 0")
