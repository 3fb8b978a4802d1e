"""Written tables that cut lineage in the folder all executors share, and joins that check sizes or spread hot keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OURS: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session of one process without one (tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rulelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _OURS:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
            pass


atexit.register(_sweep)


class Table:
    """A DataFrame written once and read back: recovery rereads the files and never recomputes."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/t-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        _OURS.append((self.spark, self.path))
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _OURS.remove((self.spark, self.path))


#: Rows, and bytes of their values, that one executor may hold as a broadcast relation.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16_000_000
#: Copies of the smaller side of a join that spreads hot keys.
SALTS = 32


def _bytes(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 24
        return 8 * F.greatest(F.size(value), F.lit(0)) + 24
    return F.lit(8)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table is counted within so many rows and bytes; reads no more rows than that."""
    cost = sum((_bytes(f.dataType, table[f"`{f.name}`"]) for f in table.schema.fields), F.lit(0))
    n, total = table.limit(rows + 1).select(cost.alias("bytes")).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return n <= rows and total <= size


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its counted rows and bytes are within the bounds; else a shuffle join runs."""
    return F.broadcast(table) if is_small(table) else table


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """rows joined with a table that has each key once, however many rows share a key: by broadcast if the table is
    small, else over copies of the table so that the rows of one key are spread over SALTS tasks."""
    if is_small(table):
        return rows.join(F.broadcast(table), key, how)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(copies, [*key, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
