"""Audience statistics: segment counts, campaign audience, status breakdowns.

Every statistic is one aggregation pass (``count_if`` / ``sum`` partial
aggregates combine map-side; the one distinct count is planned by Catalyst
as Expand + two-phase aggregation, so duplicates of a hot e-mail collapse
before the shuffle).  ``by`` turns a single-account report into one row
per account computed in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.functions.coerce import blank_to_null

# Email status codes counted by the reports.
EMAIL_STATUS_COLUMNS = (
    ("email_active", 1),
    ("email_unsubscribed", 2),
    ("email_bounced", 3),
    ("email_marked_spam", 4),
    ("email_manually_suppressed", 5),
    ("email_unconfirmed", 6),
)
SUPPRESSED_CODES = (2, 3, 4, 5)


def scope(df: DataFrame, account_id: int | None = None, deleted: str = "strict") -> DataFrame:
    """Account scope and soft-delete rule.

    ``deleted``: "strict" keeps ``is_deleted = 0`` (NULL dropped),
    "coalesce" keeps ``COALESCE(is_deleted, 0) = 0``, "include" keeps all.
    """
    if account_id is not None:
        if int(account_id) <= 0:
            raise ValueError("account_id is required and must be > 0")
        df = df.filter(F.col("account_id") == F.lit(int(account_id)))
    if deleted == "strict":
        df = df.filter(F.col("is_deleted") == 0)
    elif deleted == "coalesce":
        df = df.filter(F.coalesce(F.col("is_deleted"), F.lit(0)) == 0)
    elif deleted != "include":
        raise ValueError("deleted must be strict|coalesce|include")
    return df


def _agg(df: DataFrame, by, cols: list[Column]) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def _status_counts(status: Column, sms: Column) -> list[Column]:
    out = [F.count_if(status == code).alias(name) for name, code in EMAIL_STATUS_COLUMNS]
    out.append(F.count_if((status == 1) & (sms == 1)).alias("sms_active"))
    out.append(F.count_if((status == 1) & (sms == 5)).alias("sms_manually_suppressed"))
    return out


def segment_stats(df: DataFrame, match: Column | None = None, by=()) -> DataFrame:
    """Counts of the rows matching a segment, by status."""
    if match is not None:
        df = df.filter(match)
    st, sms = F.col("email_status"), F.col("sms_status")
    cols = [F.count_if(st == 1).alias("cnt")] + _status_counts(st, sms)
    cols.append(F.count_if(st.isin(*SUPPRESSED_CODES)).alias("email_all_suppressed"))
    return _agg(df, by, cols)


def campaign_stats(df: DataFrame, include: Column, exclude: Column | None = None, by=(),
                   key: Column | None = None, status_col: str = "email_status") -> DataFrame:
    """Campaign audience report.

    ``match = active AND include AND NOT exclude`` in three-valued logic:
    a row whose exclusion test is unknown is neither in the audience nor
    counted as excluded.
    """
    st = F.col(status_col)
    active = st == 1
    key = blank_to_null(F.col("email")) if key is None else key
    keep = F.lit(True) if exclude is None else ~exclude
    excluded = F.lit(False) if exclude is None else exclude
    match = active & include & keep
    cnt = F.count_distinct(F.when(match, key))
    cols = [
        cnt.alias("cnt"),
        (F.count_if(match & key.isNotNull()) - cnt).alias("duplicate_count"),
        F.count_if(active & include).alias("include_count"),
        F.count_if(active & include & excluded).alias("exclude_count"),
    ] + _status_counts(st, F.col("sms_status"))
    cols.append(F.count_if(st.isin(*SUPPRESSED_CODES) & include).alias("email_all_suppressed"))
    return _agg(df, by, cols)


def status_breakdown(sub: DataFrame, by=("campaign_id",)) -> DataFrame:
    """``GROUP BY status`` counts with the campaign total and channel."""
    by = [by] if isinstance(by, str) else list(by)
    grouped = sub.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("cnt"),
                                             F.min("channel").alias("channel"))
    w = Window.partitionBy(*by)
    return grouped.select(*by, "status", "cnt",
                          F.sum("cnt").over(w).alias("total"),
                          F.min("channel").over(w).alias("channel"))


def count_where(df: DataFrame, cond: Column, by=(), name: str = "cnt") -> DataFrame:
    """``count(*) FILTER (WHERE cond)``."""
    return _agg(df, by, [F.count_if(cond).alias(name), F.count(F.lit(1)).alias("total")])


def distinct_count(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.agg(F.count_distinct(F.col(col)).alias(name or f"distinct_{col}"))


def assign_ids(new: DataFrame, existing: DataFrame, by: str = "account_id", id_col: str = "id",
               order=("created_at", "name")) -> DataFrame:
    """Give a batch of new rows ids ``max(existing id) + 1, + 2, ...`` per account
    (1 when the account has none).

    The batch is dealt out by ranges of (account, order) and written once; rows
    are numbered inside their range and the ranges of an account by a sum over
    their counts, so an account of any size is numbered by many tasks."""
    spark = new.sparkSession
    keys = [F.col(by).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    from cohorta.session import scratch_dir
    path = scratch_dir(spark, "assign-ids")
    new.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    ranged = spark.read.schema(T.StructType([*new.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(by, "_range").agg(F.count("*").alias("_rows")) \
        .select(F.col(by).alias("_by"), F.col("_range").alias("_r"),
                F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    maxes = existing.groupBy(F.col(by).alias("_of")).agg(F.max(id_col).alias("_max_id"))
    inside = Window.partitionBy(by, "_range").orderBy(*keys[1:])
    out = (ranged.withColumn("_n", F.row_number().over(inside))
           .join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
           .join(maxes, F.col(by).eqNullSafe(F.col("_of")), "left"))
    return out.withColumn(id_col, F.coalesce(F.col("_max_id"), F.lit(0)) + F.col("_before") + F.col("_n")) \
              .drop("_n", "_max_id", "_range", "_by", "_r", "_before", "_of")


def preview(df: DataFrame, n: int = 20, order: str = "id", by=("account_id",),
            columns=None) -> tuple[DataFrame, DataFrame]:
    """(count per group, first ``n`` rows per group by ``order``) of one filtered frame."""
    by = list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
    cols = list(columns) if columns else df.columns
    sample = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return counts, sample.select(*dict.fromkeys(by + cols), F.col("_rn").alias("sample_rank"))
