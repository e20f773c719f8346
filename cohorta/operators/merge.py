"""Merge-on-read for change tables: latest row per key wins, tombstones drop.

Rows carry ``_op`` ('upsert' | 'delete'), ``_ts`` and ``_seq``.  For each
key the row with the greatest ``(order..., tie)`` wins (NULLs lose, as with
``DESC NULLS LAST``); if the winner is a tombstone the key disappears.
Exact ties are broken by ``_tie``, a hash of the payload that the warehouse
stores with each row, so a merge reads only key, change and wanted columns;
frames without that column get it computed.

Physical plan: ``row_number() ... = 1`` lets Catalyst insert a partial
``WindowGroupLimit`` *before* the shuffle, so a hot key is cut to one row
per map partition before it moves (skew-safe); ``method="agg"`` uses
``max_by`` with map-side partial aggregation instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.schema import MergeSpec

CHANGE_COLUMNS = ("_op", "_ts", "_seq")
TIE = "_tie"


def union_by_name(*frames: DataFrame) -> DataFrame:
    """``UNION ALL BY NAME``: missing columns become NULL."""
    frames = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def payload_tie(columns) -> Column:
    """Hash of the payload columns: the last word between equally new rows."""
    columns = [F.col(c) for c in columns]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")


def merge_latest(df: DataFrame, key, order=("_ts", "_seq"), *, null_op_is_upsert: bool = False,
                 keep_change_columns: bool = False, payload=None, method: str = "window") -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    order = list(order)
    cols = list(payload) if payload else [c for c in df.columns if c not in (*CHANGE_COLUMNS, TIE)]
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"merge: payload column {c!r} missing")
    out_cols = cols + ([c for c in CHANGE_COLUMNS if c in df.columns] if keep_change_columns else [])
    tie = F.col(TIE) if TIE in df.columns else payload_tie(c for c in cols if c not in key)
    op = F.coalesce(F.col("_op"), F.lit("upsert")) if null_op_is_upsert else F.col("_op")

    if method == "agg":
        carry = list(dict.fromkeys(out_cols + ["_op"]))
        ordering = F.struct(*[F.col(c) for c in order], tie.alias("_tie"))
        best = F.max_by(F.struct(*[F.col(c) for c in carry if c not in key]), ordering)
        merged = df.groupBy(*key).agg(best.alias("_w")).select(*key, "_w.*")
        op = F.coalesce(F.col("_op"), F.lit("upsert")) if null_op_is_upsert else F.col("_op")
        return merged.filter(op != F.lit("delete")).select(*out_cols)

    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order],
                                         F.col(TIE).desc_nulls_last())
    ranked = df.withColumn(TIE, tie).withColumn("_rn", F.row_number().over(w))
    return ranked.filter((F.col("_rn") == 1) & (op != F.lit("delete"))).select(*out_cols)


def merge_with_spec(df: DataFrame, spec: MergeSpec, keep_change_columns: bool = False,
                    method: str = "window") -> DataFrame:
    payload = [c for c in spec.payload if c in df.columns] or None
    return merge_latest(df, spec.key, spec.order, null_op_is_upsert=spec.null_op_is_upsert,
                        keep_change_columns=keep_change_columns, payload=payload, method=method)

