"""Lineage cuts for iterative plans (written tables in the folder all executors share, deleted with the session), broadcasts
of checked size, and running sums that no single task orders."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OURS: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; only a session of one process without one (tests) gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="rulelake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex}"
    _OURS.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if (spark, path) in _OURS:
        _OURS.remove((spark, path))


def _sweep() -> None:
    for spark, path in list(_OURS):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
            pass


atexit.register(_sweep)


#: Spark's setting by which the shuffle files of a finished statement are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written once to the shared folder (in folders by a column, if one is given) and read back; a lost
    executor only rereads files. What was shuffled for the write is deleted with it."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    schema, was = df.schema, df.sparkSession.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


class Held:
    """A table in the shared folder that becomes another one, mostly made from itself; what it was before is deleted."""

    def __init__(self, df: DataFrame):
        self.df = cut(df)
        self.path = _OURS[-1][1]

    def become(self, df: DataFrame) -> DataFrame:
        old = self.path
        self.__init__(df)
        _delete(self.df.sparkSession, old)
        return self.df

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def spread(scan: DataFrame) -> DataFrame:
    """A table as it was read, dealt out to as many tasks as there are cores if its files give fewer; a large table has
    more splits than that and is left as it is. For scans only: counting the tasks of other plans would run them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows numbered from 0 by a column without repeats: ranges of it are sorted on their own, and a range begins where
    those before it end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a partition's rows are numbered from 0
    dealt = cut(rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumns({"__range": F.spark_partition_id(), "__inside": inside}))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))  # a row a range
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, F.col("__base") + F.col("__inside")).drop("__base", "__inside", "__range")


#: Rows, and bytes of their JSON, that one executor may hold as a broadcast relation.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its counted rows and bytes are within the bounds; else as it is."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))), F.lit(0))
    n, total = table.limit(BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    return F.broadcast(table) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else table


def running(rows: DataFrame, by: Sequence[str], order: str, value: str, descending: bool = False) -> DataFrame:
    """rows with upto (the sum of value over the group's rows up to this one by order) and total. Rows are dealt out by
    ranges, ordered inside these, and the sums of earlier ranges added, so a group of any size is spread over tasks; no
    more than BROADCAST_ROWS in all are ordered at once."""
    key = F.desc(order) if descending else F.asc(order)
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        return rows.withColumns({"upto": F.sum(value).over(group.orderBy(key)), "total": F.sum(value).over(group)})
    return _running_in_ranges(rows, by, order, value, key)


def _running_in_ranges(rows: DataFrame, by: Sequence[str], order: str, value: str, key) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *by, key).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))  # a row for each range that a group is in
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    base = sums.withColumns({"__base": F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("__sum").over(group)})
    base = base.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__base", "total")
    on = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]]
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(key))
    return dealt.withColumn("upto", inside).join(small(base), on).withColumn("upto", F.col("upto") + F.col("__base")).drop("__part", "__p", "__base", *[f"__by{i}" for i in range(len(by))])


#: Rows of a group beyond which it is dealt out to several tasks.
GROUP_ROWS = 1_000_000


def last_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], marks: dict[str, Column], group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows with, for each mark (a name and an expression), its last value that is not null in the rows of the group
    before this one: what a machine that remembers marks knows at each row. Where a group has very many rows, rows are
    dealt out by ranges; what a range leaves behind is one row, and what came before it is looked up from those."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    told = lambda w: {name: F.last(f"__m_{name}", True).over(upto(w)) for name in marks}
    marked = rows.withColumns({f"__m_{name}": mark for name, mark in marks.items()})
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= group_rows:
        return marked.withColumns(told(Window.partitionBy(*by).orderBy(*order))).drop(*[f"__m_{name}" for name in marks])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(marked.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*order)
    left = dealt.groupBy(*by, "__part").agg(*[F.max_by(f"__m_{name}", F.when(F.col(f"__m_{name}").isNotNull(), place)).alias(f"__m_{name}") for name in marks])  # a row for each range of a group
    before = left.withColumns({f"__b_{name}": c for name, c in told(Window.partitionBy(*by).orderBy("__part")).items()})
    before = before.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[f"__b_{name}" for name in marks])
    on = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]]
    inside = dealt.withColumns(told(Window.partitionBy(*by, "__part").orderBy(*order))).join(small(before), on)
    return inside.withColumns({name: F.coalesce(name, f"__b_{name}") for name in marks}).select(*rows.columns, *marks)
