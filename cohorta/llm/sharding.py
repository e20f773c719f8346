"""Sharding by vector bin packing (operator 11).

Documents of equal text form a group.  A group's vector is its bytes, tokens
and rows, each as a share of what a shard should get, and groups are placed
one after another, largest first, where the dot product of the group's vector
with the shard's residual capacity is highest.

Only heavy groups (over one ``HEAVY_SHARES``-th of all bytes, tokens or rows,
so 3 * ``HEAVY_SHARES`` at most) are placed one by one.  All others are summed to
bundles by the size of their text and a hash of it, in tiers of halving
weight, and whole bundles are placed; the last tiers are fine enough to level
the shards.  What the driver places is bounded whatever the corpus, and a
row finds its shard from its own text.  A group that is more than a shard's
share in any of the three is cut into parts of at most some 0.8 shares,
the fewest that can be balanced; every other group stays whole.

Law: ``bytes``.  Sizes of shards are near equal (so are tokens and rows).
Sizes are the UTF-8 bytes of the text plus ``ROW_BYTES``; tokens are words.

Rows in, defined results: a null text is an empty one, and both are one group;
repeated rows are rows of their own and of one group; a null doc_id is a value
like others; equal vectors are placed in order of their hash and equal shards
by number; an empty table gives no rows; other columns are ignored, or kept
where asked for, and one named like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored

SHARDS = 40
ROW_BYTES = 16
#: A group with more than one of so many shares of the corpus is placed on its own.
HEAVY_SHARES = 20_000
#: Bundles of light groups: one per class of text size, tier and bucket.
TIERS = 6
LEAST_BUCKETS, MOST_BUCKETS = 160, 2_000
#: How much bytes, tokens and rows count in the dot product: where all three cannot be level, bytes are.
WEIGHTS = (2.0, 1.0, 1.0)
#: Parts of an oversize group hold at most this share of a shard on average.
PART_SHARE = 0.8

WORD = r"[^\x20\x09-\x0D]+"
GROUP = ("_h", "_crc", "_size")
PLACED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


class Placed(NamedTuple):
    """Items with their shards: ``heavy`` maps groups to the shards of their parts, ``light`` bundles."""

    heavy: DataFrame
    light: DataFrame


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (components in shares of a shard), in the order given."""
    left = np.tile(np.asarray(WEIGHTS), (shards, 1))
    out = np.empty(len(vectors), np.int64)
    for i, v in enumerate(vectors * WEIGHTS):
        s = int(np.argmax(left @ v))
        left[s] -= v
        out[i] = s
    return out


def buckets_for(shards: int) -> int:
    return min(max(4 * shards, LEAST_BUCKETS), MOST_BUCKETS)


def bundle_of(buckets: int) -> list[Column]:
    """(class, tier, bucket) of a light group from its size and hash."""
    bits = F.pmod("_h", F.lit(1 << 40))
    # tier k takes a half, a quarter, ... of the hashes; the last one what is left
    tier = F.least(F.lit(TIERS - 1), F.floor(-F.log2((bits + 1) / F.lit(float(1 << 40)))).cast("int"))
    return [F.floor(F.log2(F.col("_size"))).cast("int").alias("_class"), tier.alias("_tier"),
            F.pmod(F.xxhash64("_h", "_crc"), F.lit(buckets)).cast("int").alias("_bucket")]


def measured(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Stored rows: kept columns, ``_size``, ``_tokens``, ``_crc``, ``_h`` and ``_at``, an id of the row.

    ``_at`` holds the writing task in its upper bits and grows in each task."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.col(c) for c in keep if c not in PLACED]
    return stored(docs.select(
        *kept, (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("_size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"), F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_at")), "shard-rows")


def part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("_at"), parts).cast("int")


def placement(rows: DataFrame, shards: int = SHARDS) -> Placed:
    """Place all groups of ``measured`` rows."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.max("_tokens").alias("each"))
                    .select(*GROUP, (F.col("_size") * F.col("rows")).alias("bytes"),
                            (F.col("each") * F.col("rows")).alias("tokens"), "rows"), "shard-groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "rows"))).first()
    share = np.maximum(np.array([total.bytes, total.tokens, total.rows], float), 1.0) / shards
    over = [F.col(c) * HEAVY_SHARES > F.lit(int(total[c])) for c in ("bytes", "tokens", "rows")]
    is_heavy = over[0] | over[1] | over[2]

    # at most 3 * HEAVY_SHARES groups
    heavy = [(*r[:3], np.array(r[3:], float) / share) for r in groups.filter(is_heavy).collect()]
    parts = {k: int(v.max() / PART_SHARE) + 1 for *k, v in ((*(g[:3]), g[3]) for g in heavy) if v.max() > 1
             for k in [tuple(k)]}
    cut = {}
    if parts:   # at most 3 * shards groups are larger than a share
        wide = spark.createDataFrame([(*k, n) for k, n in parts.items()], "_h long, _crc long, _size long, _parts int")
        found = (rows.join(F.broadcast(wide), list(GROUP)).withColumn("_part", part_of(F.col("_parts")))
                 .groupBy(*GROUP, "_part").agg(F.count("*").alias("rows"), F.sum("_tokens").alias("tokens")).collect())
        cut = {(r._h, r._crc, r._size, r._part): np.array([r._size * r.rows, r.tokens, r.rows], float) / share
               for r in found}
    buckets = buckets_for(shards)
    bundles = (groups.filter(~is_heavy).select(*bundle_of(buckets), "bytes", "tokens", "rows")
               .groupBy("_class", "_tier", "_bucket")
               .agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
               .collect())   # a row per class, tier and bucket

    items = [((0, *g[:3], 0), g[3]) for g in heavy if tuple(g[:3]) not in parts]
    items += [((0, *k), v) for k, v in cut.items()]
    items += [((1, r[0], r[1], r[2], 0), np.array(r[3:], float) / share) for r in bundles]
    items.sort(key=lambda x: (-x[1].max(), -x[1].sum(), x[0]))
    where = dict(zip((k for k, _ in items), place(np.array([v for _, v in items]).reshape(-1, 3), shards).tolist()))
    by_group = [(*k, n, [where.get((0, *k, p), 0) for p in range(n)])
                for k, n in ((tuple(g[:3]), parts.get(tuple(g[:3]), 1)) for g in heavy)]
    return Placed(
        spark.createDataFrame(by_group, "_h long, _crc long, _size long, _parts int, _shards array<int>"),
        spark.createDataFrame([(k[1], k[2], k[3], s) for k, s in where.items() if k[0]],
                              "_class int, _tier int, _bucket int, _shard int"))


def assign(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, size, text_crc32, law, shard, slot and grown_shard of every row.

    Rows find their shard in two tables of proven size.  The slot is the place
    among the shard's rows of the writing task, after those of earlier tasks."""
    rows = measured(docs, keep)
    to = placement(rows, shards)
    kept = [c for c in keep if c not in PLACED]
    found = (rows.withColumns(dict(zip(("_class", "_tier", "_bucket"), bundle_of(buckets_for(shards)))))
             .join(F.broadcast(to.heavy), list(GROUP), "left")
             .join(F.broadcast(to.light), ["_class", "_tier", "_bucket"], "left"))
    own = F.when(F.col("_parts").isNotNull(), F.get("_shards", part_of(F.col("_parts")))).otherwise(F.col("_shard"))
    placed = found.select(*kept, "_size", "_crc", "_at", F.shiftright("_at", 33).alias("_task"), own.alias("_to"))
    counts = placed.groupBy("_to", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_to").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_to", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_to", "_task").orderBy("_at")) - 1
    return (placed.withColumn("_nth", nth).join(first, ["_to", "_task"])
            .select(*kept, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                    F.col("_to").cast("int").alias("shard"), (F.col("_first") + F.col("_nth")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write whole rows below ``folder``, one sub-folder a shard, in the order of their slots.

    Ranges of (shard, slot) go to tasks, so a shard may be written by several."""
    (assign(docs, shards, docs.columns).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(folder))
