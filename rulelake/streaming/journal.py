"""Streaming forms of journal operators. The batch forms are the reference for results; these add watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import JOURNAL


def read(spark: SparkSession, path: str) -> DataFrame:
    """Journal rows as they are appended, with their event time."""
    return spark.readStream.schema(JOURNAL).json(path).withColumn("at", F.timestamp_seconds("ts"))


def tag_counts(journal: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tags per window of event time; rows later than the watermark are left out."""
    return journal.withWatermark("at", late).select("at", F.explode("tags").alias("tag")).groupBy(F.window("at", span).alias("w"), "tag").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tag", "n")


def joined(left: DataFrame, right: DataFrame, keys: list[str], within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Two streams of facts on shared variables: each new fact meets the other side's facts of that time span."""
    a = left.withWatermark("at", late).select(*keys, F.col("at").alias("at_l"), F.col("id").alias("id_l"))
    b = right.withWatermark("at", late).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("at_r"), F.col("id").alias("id_r"))
    span = F.expr(f"INTERVAL {within}")
    on = (F.col("at_r") >= F.col("at_l") - span) & (F.col("at_r") <= F.col("at_l") + span)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, on).drop(*[f"__{k}" for k in keys])


def once(activations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (rule, facts) once within the watermark."""
    return activations.withWatermark("at", late).dropDuplicatesWithinWatermark(["rule_id", "fact_ids"])


def latest_status(signals: DataFrame) -> DataFrame:
    """The newest status of each (subject, key), as an updating table."""
    return signals.groupBy("subject", "key").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def classify(event: str, agent: str | None, interrupted: bool, last: str | None, turn: str | None) -> str | None:
    """Class of a prompt from the session's last event and last turn event; None for other events."""
    if event != "prompt":
        return None
    if agent is not None:
        return "fresh"
    if last == "interrupt":
        return "correction"
    if turn != "prompt":
        return "fresh"
    return "correction" if interrupted else "mid_turn"


def prompt_classes(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Prompts with their class, by a state machine for each session; with a time to live, a session silent so long is forgotten."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, turn = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            agent = r.agent if isinstance(r.agent, str) else None
            mode = classify(r.event, agent, bool(r.interrupted) and r.interrupted == r.interrupted, last, turn)
            if mode:
                out.append((key[0], r.seq, mode))
            last, turn = r.event, r.event if r.event in ("prompt", "stop", "session_end") else turn
        state.update((last, turn))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["sid", "seq", "mode"])
    return events.select("sid", "seq", "event", "agent", "interrupted").groupBy("sid").applyInPandasWithState(
        run, "sid string, seq long, mode string", "last string, turn string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def sink(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None], drain: bool = False):
    """Starts a query that hands each micro-batch to a consumer; a batch that is handed over again has the same number.
    drain: take what is there and stop."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()
