"""Connected components of a table of links, by alternating stars.

Each round keeps one minimum per node (combined before the shuffle) and joins it
back to the links; hot nodes are shared out by adaptive execution, as only
joins, never gathered groups, meet them.  The links of all rounds are written to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id reachable.

    Null ids and self links are ignored; an empty table gives an empty table.
    """
    edges = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    edges = edges.where("a <> b").distinct()
    edges = written(edges)
    seen = None
    while True:
        # Not one link is lost by where(a <> b): a star's own centre is known from its rays.
        edges = written(_small(_large(edges).where("a <> b").distinct()).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    root = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = root.select(F.col("component").alias("id")).distinct()
    return root.union(roots.select("id", F.col("id").alias("component")))
