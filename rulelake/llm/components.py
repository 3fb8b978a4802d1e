"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Table


def _toward_least(edges: DataFrame, keep_center: bool) -> DataFrame:
    """Links every neighbour b of a center a to the least of a's neighbours (and a)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _toward_least(both, False).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    small = _toward_least(down, True)
    linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> Table:
    """Table of (node, component): every node of an edge (a, b), with the least node that it reaches.

    Each round is written to the shared folder, so a lost executor costs no earlier round; hot nodes are
    pre-aggregated (minimum) and their join is one that Spark can split.
    """
    now = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        r = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.max("a")).first()
        if r[0] == 0 or tuple(r) == state:
            break
        state = tuple(r)
        now, old = Table(_round(now.df)), now
        old.drop()
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = Table(now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    now.drop()
    return out
