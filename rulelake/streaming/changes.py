"""A stream of assertions and retractions that keeps a rule's activations up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import FACT
from ..plans.deltas import Incremental
from .journal import sink

#: A change log as it is appended: facts with their sign and place in the log.
LOG = FACT + ", d int, seq bigint"


def read(spark, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def follow(changes: DataFrame, kept: Incremental, out: str, checkpoint: str, drain: bool = False):
    """Each micro-batch is one change; what comes and goes is written to out/batch=N. A batch that is handed over again
    after it was written is left alone. After a restart, give facts as they were when the last batch was written."""
    def act(log: DataFrame, number: int) -> None:
        spark = log.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={number}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            kept.change(log).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return sink(changes, checkpoint, act, drain)
