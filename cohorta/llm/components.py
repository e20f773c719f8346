"""Connected components of a link table, wholly on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored, tasks_for


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, and their number and sum of hashes, taken by the job that writes them."""
    seen = Observation("links")
    out = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    found = seen.get
    return out, (found.get("n") or 0, found.get("h"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node; ``links`` has long columns a and b.

    Alternating large-star and small-star steps: each aggregates a minimum by
    node (summed before the shuffle, so a hub is cheap) and joins it back.
    Every round is one job, written to the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, mark = _written(pairs)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        tasks = tasks_for(mark[0])
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = (both.join(low, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(tasks))
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        edges, now = _written(small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
