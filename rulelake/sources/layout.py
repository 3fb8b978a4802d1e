"""Facts and edges stored so that scans skip: in ranges of relation and first argument, with Bloom filters on ids.

The first argument is stored a second time, read from its end: an argument is asked for by its name or by the end of its
qualified name, and both are one range of that order. A lookup by relation and first argument reads the row groups whose
range holds it, and a lookup by id those whose Bloom filter may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stored column, and bytes of a row group: small enough that a lookup reads little.
FIRST, GROUP_BYTES = "__first", 8 << 20


def write(rows: DataFrame, path: str, relation: str = "predicate", args: str = "args", ident: str | None = "id") -> DataFrame:
    """Writes facts (predicate, args, id) or edges (p, a) and gives them as they are read from there."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn(FIRST, F.reverse(F.try_element_at(args, F.lit(1)))).repartitionByRange(parts, relation, FIRST).sortWithinPartitions(relation, FIRST)
    writer = ranged.write.option("parquet.block.size", GROUP_BYTES)
    if ident:
        writer = writer.option(f"parquet.bloom.filter.enabled#{ident}", "true")
    writer.parquet(path)
    return read(rows.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_named(wanted: str) -> Column | None:
    """Whether the stored first argument has that name or ends in it after a colon; None for wildcards."""
    if "*" in wanted or "?" in wanted:
        return None
    back = wanted[::-1]
    if wanted.startswith(":"):
        return F.col(FIRST).startswith(back)
    return (F.col(FIRST) == back) | F.col(FIRST).startswith(back + ":")


def first_is(value: str) -> Column:
    return F.col(FIRST) == value[::-1]
