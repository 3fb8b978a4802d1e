"""Hash trees of paths: two trees are compared from the root down, and only where they differ.

Every folder has a row with the number of files below it and 128 bits that stand for their paths and hashes, whatever
their order. Rows are stored by depth and sorted by parent, so the children of a few folders are a few row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders whose children are asked for by a list that the scan can skip by; more are a join.
LISTED = 500


#: Rows of a stored tree; hashes are kept as text.
NODE = "parent string, node string, files bigint, h1 bigint, h2 bigint, own string, here bigint, depth int"


def write(files: DataFrame, path: str) -> DataFrame:
    """Stores the tree of files (path, hash), and gives it as it is read from there."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), F.array_join(F.slice(parts, F.lit(1), F.greatest(i - 1, F.lit(0))), "/").alias("parent")))
    rows = files.select("path", F.col("hash").cast("string").alias("hash"), F.inline(up))
    own = (F.col("depth") == F.size(parts))
    tree = rows.withColumn("own", F.when(own, F.col("hash"))).groupBy("depth", "parent", "node").agg(
        F.count("*").alias("files"), F.bit_xor(F.xxhash64("path", "hash")).alias("h1"), F.bit_xor(F.xxhash64("path", "hash", F.lit(1))).alias("h2"), F.max("own").alias("own"), F.count_if(F.col("own").isNotNull()).alias("here"))
    count = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree.repartitionByRange(count, "depth", "parent").sortWithinPartitions("depth", "parent").write.partitionBy("depth").parquet(path)
    return read(files.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def children(tree: DataFrame, depth: int, folders: DataFrame) -> DataFrame:
    """The tree's rows of that depth below the folders (node)."""
    own = tree.where(F.col("depth") == depth)
    few = [r.node for r in folders.limit(LISTED + 1).collect()]
    return own.where(F.col("parent").isin(few)) if len(few) <= LISTED else own.join(folders.select(F.col("node").alias("parent")), "parent", "left_semi")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): files that were added, removed or changed. A level is read only below folders that differ."""
    from ..plans.tables import Held

    names = ("files", "h1", "h2", "own", "here")
    side = lambda tree, to: tree.select("node", *[F.col(c).alias(f"{c}_{to}") for c in names])
    same = lambda *columns: F.expr(" AND ".join(f"{c}_a <=> {c}_b" for c in columns))
    found, depth = [], 0
    deepest = max((r[0] for t in (old, new) for r in [t.agg(F.coalesce(F.max("depth"), F.lit(0))).first()]), default=0)
    folders: Held | None = None
    while depth <= deepest:
        a, b = (t.where("depth = 0") if folders is None else children(t, depth, folders.df) for t in (old, new))
        both = side(a, "a").join(side(b, "b"), "node", "full")
        apart = Held(both.where(~same("files", "h1", "h2")))
        if folders:
            folders.drop()
        state = F.when(F.coalesce("here_a", F.lit(0)) == 0, "added").when(F.coalesce("here_b", F.lit(0)) == 0, "removed").otherwise("changed")
        found.append(apart.df.where(~same("own") | (F.coalesce("here_a", F.lit(0)) != F.coalesce("here_b", F.lit(0)))).select(F.col("node").alias("path"), state.alias("state")))
        folders, kept = Held(apart.df.select("node")), Held(found[-1])
        apart.drop()
        found[-1] = kept.df
        if folders.df.isEmpty():
            break
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
