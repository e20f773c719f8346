"""Warehouse layout and merged table reads.

Layout under one root (all Parquet, ZSTD)::

    contact/snapshot/account_id=A/          contact/delta/account_id=A/delta_date=D/
    campaign_sub/snapshot/campaign_id=C/    campaign_sub/delta/campaign_id=C/delta_date=D/
    campaign/snapshot/account_id=A/         campaign/delta/account_id=A/delta_date=D/
    segment/account_id=A/   campaign_activity/dt=D/   dlr_event/dt=D/   api_logs/dt=D/
    receipt/dt=D/           dlr_reject/dt=D/      import_reject/dt=D/       block_file_data/

A mutable table is the merge of whatever files it has, so adding rows that
already are the latest and then removing older files never changes what is
read.  Compaction rests on that: new files are committed first, old ones are
removed afterwards, in any order.  Replacing a partition does change what is
read; marks in ``<table>/replacements/`` make it change at once
(``sources.replacements``).

Reads give an explicit schema (partition columns keep their declared
types) and let Spark prune partitions; a missing table reads as an empty
typed relation.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta import schema as S
from cohorta.operators.merge import TIE, merge_with_spec, payload_tie, union_by_name
from cohorta.sources.readers import data_files, empty_table, footer_rows, has_parquet
from cohorta.sources.replacements import Mark, Replacements, file_prefix
from cohorta.sources.writers import Shaped, write_parquet

DELTA_DATE = T.StructField("delta_date", T.DateType(), True)
FILE, FILE_BYTES = "_file", "_file_bytes"
#: Days that a partition filter names one by one.
LISTED_DAYS = 200


def not_in(rows: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` columns (NULL is a value) ``held`` does not have."""
    n, h = rows.alias("n"), held.alias("h")
    same = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in on))
    return n.join(h, same, "left_anti")


def without_event(rows: DataFrame, events: DataFrame, identity: Column) -> DataFrame:
    """Receipts (``identity``: their id) that have no event.  Ids meet as the 16 bytes that they write out; the
    day of a receipt follows from its id."""
    return rows.withColumn("_key", F.unhex(identity)).join(events.select(F.unhex("id").alias("_key")), "_key", "left_anti").drop("_key")


@dataclass
class MutableTable:
    """``lookup``: key columns by which rows are looked up.  Files are sorted by them and carry their bloom filters."""

    name: str
    schema: T.StructType
    spec: S.MergeSpec
    lookup: tuple[str, ...] = ()


TABLES = {
    "contact": MutableTable("contact", S.CONTACT, S.CONTACT_SPEC, lookup=("id",)),
    "campaign_sub": MutableTable("campaign_sub", S.CAMPAIGN_SUB, S.CAMPAIGN_SUB_SPEC, lookup=("message_id",)),
    "campaign": MutableTable("campaign", S.CAMPAIGN, S.CAMPAIGN_SPEC),
}
#: Keys that a lookup names in the plan, where Parquet tests them against row groups; more keys are joined.
LISTED_KEYS = 500
APPEND_TABLES = {
    "segment": (S.SEGMENT, ("account_id",)),
    "campaign_activity": (S.CAMPAIGN_ACTIVITY, ("dt",)),
    "dlr_event": (S.DLR_EVENT, ("dt",)),
    "receipt": (S.RECEIPT, ("dt",)),
    "dlr_reject": (S.DLR_REJECT, ("dt",)),
    "import_reject": (S.IMPORT_REJECT, ("dt",)),
    "api_logs": (S.API_LOGS_STORED, ("dt",)),
    "block_file_data": (S.BLOCK_FILE_DATA, ()),
}


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths ---------------------------------------------------------------
    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    # -- mutable tables --------------------------------------------------------
    def _read(self, path: str, schema: T.StructType) -> DataFrame | None:
        if not has_parquet(self.spark, path):
            return None
        return self.spark.read.schema(schema).parquet(path)

    def _part(self, table: str, part: str) -> DataFrame | None:
        """Stored rows of ``part`` (snapshot, delta).  A reader of both asks for the delta first: a compaction
        in between then shows its winners beside what they beat, never neither."""
        full = S.stored_layout(TABLES[table].schema)
        if part == "delta":
            return self._read(self.path(table, part), T.StructType([*full.fields, DELTA_DATE]))
        return self.replacements(table).read(lambda: self._read(self.path(table, part), full))

    def replacements(self, table: str) -> Replacements:
        return Replacements(self.spark, self.path(table, "replacements"), self.path(table, "snapshot"),
                            TABLES[table].spec.partition_by[0])

    def files(self, table: str, part: str) -> DataFrame | None:
        """Stored rows of ``part`` (snapshot, delta) with the name and the size of their file.

        The files are listed once, here: what is added later is not read."""
        df = self._part(table, part)
        return df if df is None else df.withColumns(
            {FILE: F.col("_metadata.file_path"), FILE_BYTES: F.col("_metadata.file_size")})

    def changes(self, table: str, key_filter: Column | None = None, until: _dt.date | None = None) -> DataFrame:
        """Snapshot and delta rows with change columns (``UNION ALL BY NAME``).

        ``until`` leaves out the deltas of later days."""
        full = S.stored_layout(TABLES[table].schema)
        later = self._part(table, "delta")
        snapshot = self._part(table, "snapshot")
        if later is not None and until is not None:
            later = later.filter(F.col("delta_date") <= F.lit(until))
        parts = [p.drop("delta_date") for p in (snapshot, later) if p is not None]
        df = union_by_name(*parts) if parts else empty_table(self.spark, full)
        return df if key_filter is None else df.filter(key_filter)

    def table(self, table: str, key_filter: Column | None = None, keep_change_columns: bool = False,
              method: str = "window", keys: DataFrame | None = None, until: _dt.date | None = None) -> DataFrame:
        """Merged view: latest row per key, tombstones removed; with ``until`` as the deltas up to that day make it.

        ``key_filter`` on partition columns (account_id / campaign_id) is
        applied below the merge, so it prunes partitions; ``keys`` (distinct
        values of some key columns) selects by a semi-join there."""
        t = TABLES[table]
        rows = self.changes(table, key_filter, until)
        if keys is not None:
            rows = rows.join(keys, keys.columns, "left_semi")
        return merge_with_spec(rows, t.spec, keep_change_columns, method)

    def delta_keys(self, table: str, after: _dt.date, until: _dt.date) -> DataFrame:
        """Distinct keys named by the deltas later than ``after``, up to ``until``."""
        t = TABLES[table]
        rows = self._part(table, "delta")
        if rows is None:
            return empty_table(self.spark, S.stored_layout(t.schema)).select(*t.spec.key)
        day = F.col("delta_date")
        return rows.filter((day > F.lit(after)) & (day <= F.lit(until))).select(*t.spec.key).distinct()

    def contact(self, account_id: int | None = None) -> DataFrame:
        kf = F.col("account_id") == F.lit(int(account_id)) if account_id is not None else None
        return self.table("contact", kf)

    def campaign_sub(self, campaign_id: int | None = None) -> DataFrame:
        kf = F.col("campaign_id") == F.lit(int(campaign_id)) if campaign_id is not None else None
        return self.table("campaign_sub", kf)

    def campaign(self, account_id: int | None = None) -> DataFrame:
        kf = F.col("account_id") == F.lit(int(account_id)) if account_id is not None else None
        return self.table("campaign", kf)

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """Merged rows of ``table`` by values of its lookup column.

        Up to ``LISTED_KEYS`` values go into the plan as a pushed filter, which
        Parquet tests against the bloom filter and the value range of each row
        group and page before it reads them; more are a semi-join.  Either way
        whole keys are selected before the merge."""
        (column,) = TABLES[table].lookup
        return merge_with_spec(self._by_keys(self.changes(table), keys.select(column), column), TABLES[table].spec)

    def _by_keys(self, rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        few = keys.filter(F.col(column).isNotNull()).distinct().limit(LISTED_KEYS + 1).collect()
        if len(few) <= LISTED_KEYS:
            return rows.filter(F.col(column).isin([r[0] for r in few]) if few else F.lit(False))
        return rows.join(keys.distinct(), column, "left_semi")

    def subscribers_for(self, receipts: DataFrame) -> DataFrame:
        """Merged subscriber rows that ``receipts`` (message_id, campaign_id) can mean: those of their message ids.

        ``message_id`` is part of the merge key, so whole keys are selected
        before the merge and only those are ranked and shuffled, by message id
        as the receipts are joined to them.  A batch of up to ``LISTED_KEYS``
        receipts names its message ids in the plan (``lookup``)."""
        ids = receipts.filter("message_id <> ''").select("message_id")
        few = ids.limit(LISTED_KEYS + 1).collect()
        rows = self.changes("campaign_sub")
        if len(few) <= LISTED_KEYS:
            rows = rows.filter(F.col("message_id").isin(sorted({r[0] for r in few})) if few else F.lit(False))
        else:
            rows = rows.join(ids.distinct(), "message_id", "left_semi")
        return merge_with_spec(rows, TABLES["campaign_sub"].spec)

    # -- append tables -----------------------------------------------------------
    def append_table(self, table: str) -> DataFrame:
        schema, _ = APPEND_TABLES[table]
        df = self._read(self.path(table), schema)
        return df if df is not None else empty_table(self.spark, schema)

    def api_logs(self, day: _dt.date | None = None) -> DataFrame:
        """Merged logs, the last state of each message; with ``day`` those whose last state is of that day.

        A row of a later time lies in a later day, so a day's last states are
        decided by the partitions from that day on: earlier ones are not read."""
        rows = self.append_table("api_logs")
        if day is None:
            return merge_with_spec(rows, S.API_LOGS_SPEC)
        own = F.lit(day)
        return merge_with_spec(rows.filter(F.col("dt") >= own), S.API_LOGS_SPEC).filter(F.col("dt") == own)

    def segments(self, account_id: int | None = None) -> DataFrame:
        """Saved segments, the latest version of each (account_id, id)."""
        df = self.append_table("segment")
        if account_id is not None:
            df = df.filter(F.col("account_id") == F.lit(int(account_id)))
        cols = [c for c in S.SEGMENT.fieldNames() if c not in ("account_id", "id")]
        order = F.struct(F.col("updated_at"), F.col("created_at"), F.coalesce("filter_json", F.lit("")))
        best = df.groupBy("account_id", "id").agg(F.max_by(F.struct(*cols), order).alias("s"))
        return best.select("id", "account_id", *[F.col(f"s.{c}") for c in cols])

    # -- writes --------------------------------------------------------------------
    def _stored(self, table: str, df: DataFrame) -> DataFrame:
        t = TABLES[table]
        payload = [c for c in t.schema.fieldNames() if c not in t.spec.key]
        return df.select(*S.with_change_columns(t.schema).fieldNames()).withColumn(TIE, payload_tie(payload))

    def write_delta(self, table: str, df: DataFrame | Shaped, delta_date) -> None:
        day = F.lit(delta_date).cast("date")

        def stored(rows: DataFrame) -> DataFrame:
            return self._stored(table, df.shape(rows)).withColumn("delta_date", day)

        out, shape = (df.rows.withColumn("delta_date", day), stored) if isinstance(df, Shaped) \
            else (self._stored(table, df).withColumn("delta_date", day), None)
        write_parquet(out, self.path(table, "delta"), "append", shape=shape,
                      partition_by=(*TABLES[table].spec.partition_by, "delta_date"), lookup=TABLES[table].lookup)

    def write_snapshot(self, table: str, df: DataFrame) -> None:
        """First load: replace the snapshot partitions present in ``df`` (others untouched)."""
        self.finish_replacements(table)
        write_parquet(self._stored(table, df), self.path(table, "snapshot"), "overwrite",
                      partition_by=TABLES[table].spec.partition_by, lookup=TABLES[table].lookup)

    def add_snapshot_rows(self, table: str, df: DataFrame) -> None:
        self.finish_replacements(table)
        self._add(table, df)

    def _add(self, table: str, df: DataFrame, prefix: str | None = None) -> None:
        write_parquet(self._stored(table, df), self.path(table, "snapshot"), "append", file_prefix=prefix,
                      partition_by=TABLES[table].spec.partition_by, lookup=TABLES[table].lookup)

    def replace_partition(self, table: str, df: DataFrame, value: int, keep_old: bool = False) -> None:
        """Replace the snapshot of one account or campaign by ``df``, which may be empty.

        Readers see the old rows until all new ones are stored, and from then on
        only these, whenever a run stops.  ``keep_old`` leaves the old files, so
        that reads planned before go on, until ``finish_replacements`` or the
        next write of a snapshot."""
        self.finish_replacements(table)
        log = self.replacements(table)
        mark = log.begin(value)
        self.add_replacement_rows(table, df, mark)
        log.switch(mark)
        if not keep_old:
            self.finish_replacements(table)

    def add_replacement_rows(self, table: str, df: DataFrame, mark: Mark) -> None:
        """Store the rows of ``df`` that belong to a replacement's partition; its switch shows them."""
        own = F.col(TABLES[table].spec.partition_by[0]) == F.lit(mark.value)
        self._add(table, df.filter(own), file_prefix(mark.number))

    def finish_replacements(self, table: str) -> int:
        """Undo replacements that stopped before their switch, remove what the others replaced."""
        return self.replacements(table).finish()

    def append(self, table: str, df: DataFrame) -> None:
        schema, parts = APPEND_TABLES[table]
        write_parquet(df.select(*schema.fieldNames()), self.path(table), "append",
                      partition_by=parts)

    def append_new(self, table: str, df: DataFrame | Shaped, keys: tuple[str, ...]) -> None:
        """Append rows whose ``keys`` the table does not hold yet in the same day.

        Makes a repeated delivery or a replayed batch add nothing, however late
        it comes: no state that could be forgotten, only the days of the rows
        are read."""
        schema, parts = APPEND_TABLES[table]
        on = [*parts, *keys]
        shaped = isinstance(df, Shaped)
        rows = df.rows if shaped else df.select(*schema.fieldNames())
        fresh = rows if shaped else rows.dropDuplicates(on)
        if has_parquet(self.spark, self.path(table)):
            fresh = not_in(fresh, self.days_of(table, rows).select(*on), on)
        write_parquet(fresh, self.path(table), "append", partition_by=parts,
                      shape=(lambda r: df.shape(r).select(*schema.fieldNames())) if shaped else None)

    def days_of(self, table: str, df: DataFrame, days: list | None = None) -> DataFrame:
        """Rows of a daily table of the days that ``df`` has, by a partition filter.

        Up to ``LISTED_DAYS`` days are named (there are never more than a calendar
        has); a batch over more reads all days between its first and its last."""
        if days is None:
            days = [r.dt for r in df.select("dt").distinct().collect()]
        known = sorted(d for d in days if d is not None)
        named = ", ".join(f"DATE '{d}'" for d in known) if len(known) <= LISTED_DAYS else None
        tests = [f"dt IN ({named})" if named else f"dt BETWEEN DATE '{known[0]}' AND DATE '{known[-1]}'"] if known else []
        tests += ["dt IS NULL"] if len(known) < len(days) else []
        return self.append_table(table).filter(" OR ".join(tests) or "false")

    # -- receipts ------------------------------------------------------------------
    def open_rejects(self, messages: DataFrame | None = None) -> DataFrame:
        """Receipts that were not applied, neither then nor since: reject rows without an event.

        ``messages`` (message_id) keeps only receipts of such messages."""
        rows = self.append_table("dlr_reject")
        if messages is not None:
            rows = rows.join(messages.select("message_id").distinct(), "message_id", "left_semi")
        return without_event(rows, self.append_table("dlr_event"), F.col("id")).select(*S.DLR_REJECT.fieldNames())

    # -- inventory -----------------------------------------------------------------
    def inventory(self) -> DataFrame:
        """Files, partitions, rows and bytes of each table part, from the listing and the files' footers.

        It tells what is stored: files of an unfinished replacement are counted.  No row or column is read: Spark lists the names, tasks open the footers."""
        parts = {f"{name}_{label}": self.path(name, label) for name in TABLES for label in ("snapshot", "delta")}
        parts |= {name: self.path(name) for name in APPEND_TABLES}
        found = None
        for label, path in parts.items():
            if has_parquet(self.spark, path):
                files = data_files(self.spark, path).withColumn("table_part", F.lit(label))
                found = files if found is None else found.unionByName(files)
        if found is None:
            return self.spark.createDataFrame([], "table_part string, files bigint, partitions bigint, rows bigint, bytes bigint")
        return footer_rows(found).groupBy("table_part").agg(
            F.count("*").alias("files"), F.count_distinct("partition").alias("partitions"),
            F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
