"""Sinks: versioned tables with checksums, appended logs, rotation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Corrupt(ValueError):
    """A stored version whose rows do not match its recorded count and checksum."""


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free hash of them."""
    r = df.agg(F.count("*"), F.coalesce(F.sum((F.xxhash64(*df.columns) % 1_000_000_007).cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def seal(lines: DataFrame) -> tuple[int, str]:
    """Number of record lines (value), and their FNV-1a64 hashes folded into one whatever their order."""
    from ..functions.text import fnv1a64

    hashed = lines.select(fnv1a64(F.col("value")).alias("h"))
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    r = hashed.agg(F.count("*"), F.coalesce(F.bit_xor(half(1)), F.lit(0)), F.coalesce(F.bit_xor(half(9)), F.lit(0))).first()
    return int(r[0]), f"{r[1]:08x}{r[2]:08x}"


def unsealed(lines: DataFrame, records: int, digest: str) -> DataFrame:
    """The record lines if they are those that were sealed; an error if one was lost, added or changed."""
    if seal(lines) != (records, digest):
        raise Corrupt("record lines differ from their seal")
    return lines


class Store:
    """A table kept as versions; a version counts only once its record (count, checksum) is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version long, n long, hash string").json(f"{self.path}/log")
        except AnalysisException:
            return None

    def latest(self) -> int:
        known = self.versions()
        return -1 if known is None else int(known.agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0])

    def write(self, df: DataFrame) -> int:
        version = self.latest() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        n, h = checksum(self.spark.read.parquet(f"{self.path}/v{version}"))
        self.spark.createDataFrame([(version, n, str(h))], "version long, n long, hash string").coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version

    def load(self) -> DataFrame | None:
        """The latest version after its check; None if there is none."""
        version = self.latest()
        if version < 0:
            return None
        df = self.spark.read.parquet(f"{self.path}/v{version}")
        want = self.versions().where(F.col("version") == version).first()
        if checksum(df) != (want.n, int(want.hash)):
            raise Corrupt(f"version {version} of {self.path}")
        return df


def append_log(df: DataFrame, path: str, most_bytes: int = 50 * (1 << 20)) -> None:
    """Rows as JSON lines after those already there. A log beyond the size is first set aside as its one predecessor
    (path.1, whose own content goes); rows are written only then, so none is in both."""
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and fs.getContentSummary(at(path)).getLength() > most_bytes:
        fs.delete(at(f"{path}.1"), True)
        if not fs.rename(at(path), at(f"{path}.1")):
            raise OSError(f"cannot set {path} aside")
    df.write.mode("append").json(path)


def rotated(log: DataFrame, most_bytes: int = 50 * (1 << 20)) -> DataFrame:
    """log with its generation: 1 for the newest rows within the size, 0 for those before; older ones are dropped at
    twice the size. Sizes are summed by second, so that no task orders the whole log."""
    from ..plans.tables import running

    size = F.octet_length(F.to_json(F.struct(*log.columns))) + 1
    per = log.withColumn("__size", size).groupBy("ts").agg(F.sum("__size").alias("__size"))
    upto = F.col("upto")
    marked = running(per, [], "ts", "__size", descending=True).select("ts", F.when(upto <= most_bytes, 1).when(upto <= 2 * most_bytes, 0).alias("generation")).where("generation IS NOT NULL")
    return log.join(marked, "ts")


def json_report(df: DataFrame, most: int = 1000) -> str:
    """The first rows as a JSON array, for hosts that read reports."""
    return json.dumps([r.asDict(recursive=True) for r in df.limit(most).collect()], ensure_ascii=False, default=str)


def text_report(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a table for terminals: a head and a line for each row, numbers to the right; longer values are not cut."""
    kinds = dict(df.dtypes)
    def cell(value, column: str):
        pad = F.lpad if kinds[column] in ("int", "bigint", "double", "float", "smallint", "tinyint") else F.rpad
        wide = F.greatest(F.length(value), F.lit(widths[column]))
        return pad(value, wide, F.lit(" "))
    line = lambda of: F.concat_ws("  ", *[cell(of(c), c) for c in widths])
    head = df.sparkSession.range(1).select(line(lambda c: F.lit(c)).alias("line"))
    return head.unionByName(df.select(line(lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("line")))
