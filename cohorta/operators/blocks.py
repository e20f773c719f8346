"""Block-file membership: semi join, anti join and boolean flag columns.

``block_file_data(block_file_id, unique_identifier)`` lists identifiers
per block file.  A contact is "in" a set of block files when its match
column (default ``f2``) equals an identifier of one of them (SQL EXISTS).

Plan shape:
* the block side is reduced to one row per identifier before the join
  (``groupBy`` with map-side partial aggregation, so duplicate identifiers
  never multiply contact rows) and is built once;
* nothing is run while the plan is made: the adaptive planner broadcasts the
  reduced side when its measured bytes allow and shuffles otherwise, splitting
  hot keys;
* contact rows with a NULL match key never match; they are spread by a hash
  of the row key instead of all going to one reducer;
* a semi join first tests each contact against a bitmap of the hashes of the
  listed identifiers (a scalar subquery of fixed size), so where the sides are
  shuffled, only contacts that may match move.  The join still decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the bitmap (512 KB).  With many more identifiers than cells it lets most contacts pass.
CELLS = 1 << 22
_WORD_BITS = 64
_KEY = "_blk_key"
_KEY_NULL = "_blk_key_null"


def flag_name(ids) -> str:
    return "_blk_" + "_".join(str(int(i)) for i in sorted(set(ids)))


def block_keys(blocks: DataFrame, id_sets: list[tuple[int, ...]]) -> DataFrame:
    """One row per identifier with one boolean column per id set."""
    all_ids = sorted({i for s in id_sets for i in s})
    b = blocks.filter(F.col("block_file_id").isin(all_ids) & F.col("unique_identifier").isNotNull())
    aggs = [F.max(F.col("block_file_id").isin(list(s))).alias(flag_name(s)) for s in id_sets]
    return b.groupBy(F.col("unique_identifier").alias(_KEY)).agg(*aggs)


def _cell(key: Column, cells: int) -> tuple[Column, Column]:
    """(word, bit) of a key's cell."""
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    return F.floor(cell / _WORD_BITS).cast("int"), (cell % _WORD_BITS).cast("int")


def may_be_listed(match: Column, keys: DataFrame, cells: int = CELLS) -> Column:
    """Is ``match`` perhaps among ``keys`` (one column)?  Never false for one that is.

    The bitmap is an array of ``cells / 64`` longs, computed once when the query runs."""
    word, bit = _cell(F.col(keys.columns[0]), cells)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(cells // _WORD_BITS).select(F.col("id").cast("int").alias("word"))
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bitmap = every.join(words, "word", "left").agg(pairs.alias("p")).select(F.col("p.bits")).scalar()
    word, bit = _cell(match, cells)
    return F.call_function("shiftright", F.get(bitmap, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1


def _probe(df: DataFrame, match_field: str) -> DataFrame:
    """Join keys of the contact side: (is_null, key or hash of the row key)."""
    row_key = [c for c in ("account_id", "id") if c in df.columns] or df.columns[:1]
    spread = F.xxhash64(*[F.col(c) for c in row_key]).cast("string")
    m = F.col(match_field).cast("string")
    return df.withColumns({_KEY_NULL: m.isNull(), _KEY: F.coalesce(m, spread)})


def _join(df: DataFrame, keys: DataFrame, match_field: str, how: str) -> DataFrame:
    keys = keys.withColumn(_KEY_NULL, F.lit(False))
    return _probe(df, match_field).join(keys, [_KEY_NULL, _KEY], how).drop(_KEY, _KEY_NULL)


def add_block_flags(df: DataFrame, blocks: DataFrame, id_sets: list[tuple[int, ...]],
                    match_field: str = "f2") -> DataFrame:
    """Add one non-NULL boolean column per id set (``flag_name(ids)``)."""
    if not id_sets:
        return df
    keys = block_keys(blocks, id_sets)
    out = _join(df, keys, match_field, "left")
    return out.withColumns({flag_name(s): F.coalesce(F.col(flag_name(s)), F.lit(False))
                            for s in id_sets})


def block_semi(df: DataFrame, blocks: DataFrame, ids, match_field: str = "f2") -> DataFrame:
    """Rows whose match key is listed in any of the block files (EXISTS)."""
    keys = block_keys(blocks, [tuple(sorted(set(ids)))]).select(_KEY)
    return _join(df.filter(may_be_listed(F.col(match_field).cast("string"), keys)), keys, match_field, "left_semi")


def block_anti(df: DataFrame, blocks: DataFrame, ids, match_field: str = "f2") -> DataFrame:
    """Rows whose match key is in none of the block files (NOT EXISTS);
    rows with a NULL key are kept."""
    keys = block_keys(blocks, [tuple(sorted(set(ids)))]).select(_KEY)
    return _join(df, keys, match_field, "left_anti")

