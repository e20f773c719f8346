"""Paging, newest-first lists, key lookups and text search.

Pages are "top-k" reports: ``row_number() <= offset + limit`` per group,
which Catalyst plans with a partial ``WindowGroupLimit`` before the shuffle
(each map task forwards at most offset+limit rows per group), or
``TakeOrderedAndProject`` for a single global page.  NULLs sort last in
both directions.
"""

from __future__ import annotations

import re
from collections.abc import Container, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.session import kept

#: Largest page and projection unless the caller names another; asking for more raises.
MAX_LIMIT = 10000
MAX_KEYSET = 100
MAX_SELECT = 40
#: Ranges into which a deep page cuts the order of a group.
DEEP_RANGES = 128


#: Columns of a request, and of a contact list, that names none.
DEFAULT_SELECT = ("id", "account_id", "primary_key", "email", "mobile", "email_status", "domain")
DEFAULT_LIST = ("id", "email", "mobile", "first_name", "last_name", "city", "country", "company", "lifecycle_stage",
                "email_status", "sms_status")
LEAST_LIST = ("id", "email")
_DESCENDING = {"ASC": False, "DESC": True}


def page_size(asked: int, most: int, otherwise: int | None = None) -> int:
    """Rows of a page; none asked for (0 or less) means ``otherwise`` where there is such a size."""
    if asked <= 0 and otherwise is not None:
        return otherwise
    if asked not in range(most + 1):
        raise ValueError(f"limit {asked} is outside 0..{most}")
    return asked


def descending(order_dir: str) -> bool:
    try:
        return _DESCENDING[str(order_dir).upper()]
    except KeyError:
        raise ValueError(f"order_dir {order_dir!r} is neither ASC nor DESC") from None


def _sort(col: str, desc: bool) -> Column:
    return F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()


def sort_keys(order_by: str, order_dir: str = "ASC", tie: str | None = None) -> list[Column]:
    """Order of a list: NULLs last in both directions, then the tie-break upwards."""
    return [_sort(order_by, descending(order_dir)), *([_sort(tie, False)] if tie and tie != order_by else [])]


def page(df: DataFrame, order_by: str, order_dir: str = "ASC", limit: int = 25, offset: int = 0,
         by=None, tie: str | None = None, max_limit: int = MAX_LIMIT) -> DataFrame:
    """``ORDER BY order_by [tie] LIMIT limit OFFSET offset`` — per ``by`` group
    when given (one page per account), else one global page."""
    limit, offset = page_size(limit, max_limit), max(0, int(offset))
    keys = sort_keys(order_by, order_dir, tie)
    if not by:
        return df.orderBy(*keys).offset(offset).limit(limit)
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(*keys)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    return ranked.filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)) \
                 .withColumn("page_rank", F.col("_rn") - offset).drop("_rn")


def _at_or_before(mark: Column, row_key: Column, row_tie: Column | None, desc: bool) -> Column:
    """Whether a mark (k, t) is at or before a row in the order of a list."""
    k = mark["k"]
    tie = F.lit(True) if row_tie is None else F.coalesce(mark["t"] <= row_tie, row_tie.isNull())
    ahead = k > row_key if desc else k < row_key
    return (F.when(k.isNull() & row_key.isNull(), tie).when(k.isNull(), F.lit(False)).when(row_key.isNull(), F.lit(True))
            .otherwise(ahead | ((k == row_key) & tie)))


def deep_page(df: DataFrame, order_by: str, order_dir: str = "ASC", limit: int = 25, offset: int = 0,
              by=(), tie: str | None = None, max_limit: int = MAX_LIMIT, ranges: int = DEEP_RANGES) -> DataFrame:
    """The rows of ``page`` for offsets of any depth, with their ``page_rank``.

    ``page`` keeps offset + limit rows of a group and ranks them in one task.
    Here up to ``ranges`` rows of each group, chosen by a hash, mark ranges of
    the order; a binary search among the marks finds the range of a row.  One
    pass counts the rows of each range, so it is known which ranges hold the
    page and how many rows lie before them, and only those are sorted, each in
    a task of its own.  Marks and counts are stored, so Spark knows how small
    they are and sends them to the rows, not the rows to them."""
    limit, offset, desc = page_size(limit, max_limit), max(0, int(offset)), descending(order_dir)
    by, spark = [by] if isinstance(by, str) else list(by), df.sparkSession
    key, last = F.col(order_by), F.col(tie) if tie and tie != order_by else None
    names = [f"_g{i}" for i, _ in enumerate(by)]
    mark = F.struct(key.alias("k"), (F.lit(0) if last is None else last).alias("t"))
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, names, strict=True)], mark.alias("_mark"), F.xxhash64(mark).alias("_hash"))
    least = kept(spark, rows.groupBy(*names, F.pmod("_hash", F.lit(ranges)).alias("_slot")).agg(F.min("_hash").alias("_least")), "page-slots")
    slots = least.select(*[F.col(g).alias(f"_s{g}") for g in names], "_least")
    chosen = rows.join(slots, _all([F.col(g).eqNullSafe(F.col(f"_s{g}")) for g in names] + [F.col("_hash") == F.col("_least")]),
                       "left_semi").select(*names, "_mark").distinct()
    place = F.row_number().over(Window.partitionBy(*(names or [F.lit(0)])).orderBy(*sort_keys("_mark.k", order_dir, "_mark.t")))
    marks = kept(spark, chosen.withColumn("_place", place).groupBy(*names).agg(
        F.sort_array(F.collect_list(F.struct("_place", "_mark"))).alias("_marks")), "page-marks")
    ranged = (df.join(marks, _all([F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, names, strict=True)]), "left")
              if by else df.join(F.broadcast(marks)))         # without groups it is one row
    # two rows of one hash may both be marks: a search over twice the ranges reaches them all
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((2 * ranges).bit_length()))])

    def search(at: Column, step: Column) -> Column:
        tested = F.get("_marks", at + step - 1)["_mark"]
        return F.when((at + step <= F.size("_marks")) & _at_or_before(tested, key, last, desc), at + step).otherwise(at)

    ranged = ranged.withColumn("_range", F.aggregate(steps, F.lit(0), search))
    ranged = ranged.select(*df.columns, "_range")
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")
    counted = (ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
               .withColumn("_before", F.sum("_rows").over(order) - F.col("_rows"))
               .filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_rows") > offset)))
    wanted = kept(spark, counted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(by)], F.col("_range").alias("_wr"), "_before"),
                  "page-ranges")
    mine = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(by)] + [F.col("_range") == F.col("_wr")]
    inside = Window.partitionBy(*by, "_range").orderBy(*sort_keys(order_by, order_dir, tie))
    found = ranged.join(wanted, _all(mine)).withColumn("_rn", F.col("_before") + F.row_number().over(inside))
    return found.filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)) \
        .select(*df.columns, (F.col("_rn") - offset).cast("int").alias("page_rank"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def keyset_page(df: DataFrame, key: str = "id", after: int = 0, limit: int = 25, by=None,
                max_limit: int = MAX_KEYSET) -> DataFrame:
    """``key > after ORDER BY key LIMIT limit+1``: returns ``limit`` rows plus
    ``has_more`` and ``next_after`` per group (0 means 25; above ``max_limit`` raises)."""
    limit = page_size(limit, max_limit, 25)
    src = df.filter(F.col(key) > F.lit(after)) if after and after > 0 else df
    by = [] if not by else ([by] if isinstance(by, str) else list(by))
    w = Window.partitionBy(*by).orderBy(F.col(key).asc_nulls_last()) if by else \
        Window.orderBy(F.col(key).asc_nulls_last())
    if not by:
        fetched = src.orderBy(F.col(key).asc_nulls_last()).limit(limit + 1) \
                     .withColumn("_rn", F.row_number().over(w))
    else:
        fetched = src.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit + 1)
    g = Window.partitionBy(*by) if by else Window.partitionBy()
    out = fetched.withColumns({
        "has_more": F.max("_rn").over(g) > F.lit(limit),
    }).filter(F.col("_rn") <= limit)
    return out.withColumn("next_after", F.max(key).over(g)).drop("_rn")


def newest_first(df: DataFrame, col: str, limit: int | None = None, tie: str | None = None,
                 by=None) -> DataFrame:
    """Newest rows first (``col DESC``), with an ascending unique tie-break."""
    if limit is None:
        keys = [_sort(col, True)] + ([_sort(tie, False)] if tie else [])
        return df.orderBy(*keys)
    return page(df, col, "DESC", limit, 0, by=by, tie=tie)


def lookup(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``: many point lookups as one semi join,
    broadcast or shuffled by the measured size of the keys."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def _like_any(cols: list[Column], q: str) -> Column:
    pat = f"%{q}%"  # the search text is not escaped: % and _ act as wildcards
    out = None
    for c in cols:
        t = c.cast("string").ilike(pat)
        out = t if out is None else (out | t)
    return out


def search_contacts(df: DataFrame, q: str) -> DataFrame:
    """Free-text contact search; an all-digit query means ``id = q``."""
    q = q or ""
    if q == "":
        return df
    if re.fullmatch(r"-?\d+", q.strip()):
        return df.filter(F.col("id") == F.lit(int(q.strip())))
    cols = [F.col("email"), F.col("first_name"), F.col("last_name"),
            F.coalesce(F.col("company"), F.lit("")), F.coalesce(F.col("city"), F.lit(""))]
    return df.filter(_like_any(cols, q))


def search_subscribers(df: DataFrame, q: str = "", status: int | None = None) -> DataFrame:
    if q:
        df = df.filter(_like_any([F.col("recipient"), F.col("primary_key"), F.col("message_id")], q))
    if status is not None:
        df = df.filter(F.col("status") == F.lit(int(status)))
    return df


def filter_logs(df: DataFrame, dt: str = "", channel_id: int = 0, status: int | None = None,
                q: str = "") -> DataFrame:
    """Api-log filter.  ``dt`` is compared as a DATE; on merged logs ask ``Warehouse.api_logs(day)`` for the day, which
    reads its partitions only."""
    if dt:
        import datetime as _d
        df = df.filter(F.col("dt") == F.lit(_d.date.fromisoformat(dt)))
    if channel_id and channel_id > 0:
        df = df.filter(F.col("channel_id") == F.lit(int(channel_id)))
    if status is not None:
        df = df.filter(F.col("status") == F.lit(int(status)))
    if q:
        df = df.filter(_like_any([F.col("message_id"), F.coalesce(F.col("recipient"), F.lit(""))], q))
    return df


def projection(asked: Sequence[str], known: Container[str], most: int | None = None) -> tuple[list[str], list[str]]:
    """Names in the order asked for, as (known ones, others)."""
    if most is not None and len(asked) > most:
        raise ValueError(f"at most {most} columns can be selected, not {len(asked)}")
    names = [str(name).strip() for name in asked]
    return [n for n in names if n in known], [n for n in names if n not in known]


def resolve_select(select, catalog_names, default=DEFAULT_SELECT, max_select: int = MAX_SELECT) -> list[str]:
    """Columns of a request: every one must be known; ``*`` or nothing means ``default``."""
    if isinstance(select, (list, tuple)):
        found, strange = projection(select, catalog_names, max_select)
        if found and not strange:
            return found
        raise ValueError(f"unknown select columns: {', '.join(strange)}" if strange else "select names no column")
    if select in (None, "", "*"):
        return list(default)
    raise ValueError(f"select is no list of columns: {select!r}")


def whitelist_columns(columns, catalog_names, default=DEFAULT_LIST) -> list[str]:
    """Columns of a contact list: others than known ones are passed over, ``id`` is always there."""
    found, _ = projection(columns or default, catalog_names)
    found = found or list(LEAST_LIST)
    return found if "id" in found else ["id", *found]


def list_contacts(df: DataFrame, catalog_names, q: str = "", limit: int = 25, after_id: int = 0,
                  offset: int = 0, columns=None, by=("account_id",), max_limit: int = MAX_KEYSET) -> DataFrame:
    """Contact list: whitelisted columns (``id`` always), search, keyset page
    by id (offset only when there is no cursor), ``has_more`` and
    ``next_after`` per account."""
    limit = page_size(limit, max_limit, 25)
    cols = whitelist_columns(columns, catalog_names)
    src = search_contacts(df, q)
    if after_id and after_id > 0:
        return keyset_page(src.select(*dict.fromkeys(list(by) + cols)), "id", after_id, limit, by=list(by),
                           max_limit=max_limit)
    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.col("id").asc_nulls_last())
    ranked = src.select(*dict.fromkeys(by + cols)).withColumn("_rn", F.row_number().over(w)) \
                .filter(F.col("_rn") <= offset + limit + 1)
    g = Window.partitionBy(*by)
    out = ranked.withColumn("has_more", F.max("_rn").over(g) > F.lit(offset + limit)) \
                .filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit))
    return out.withColumn("next_after", F.max("id").over(g)).drop("_rn")


def list_segments(segments: DataFrame, limit: int | None = None, by=("account_id",)) -> DataFrame:
    """Saved segments, newest update first (per account when limited)."""
    return newest_first(segments, "updated_at", limit, tie="id", by=list(by) if limit is not None else None)
