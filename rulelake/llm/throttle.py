"""Token-bucket throttling of clicks in a stateful stream.

Every client has a credit of microseconds: it starts full, gains the time between its settled clicks up to a limit, and
an admitted click takes its cost.  A click that finds less than its cost is throttled; the penalty lasts from the first
throttled click after an admission until the credit reaches the cost again.

Clicks come in batches, out of order.  The watermark W of a batch is the largest time of all earlier batches less an
allowance.  A batch's own clicks before W are late; the others wait until a batch's W has passed them, or until the
last batch.  So a client's clicks settle by time and click_id, whatever order they came in.

The stream is keyed by hash bucket, and one bucket's state holds many clients: credits and waiting clicks as packed
columns (differences, bytes by significance, zstd).  One tick row per bucket and batch carries W, so that buckets
without clicks settle too.  A bucket's due clicks are brought into order by one lexsort, and an integer loop runs
through them.  A client whose credit is full again by W is dropped: it is as good as new.

The number of buckets follows the counted clicks; a bucket's state and the clicks that it settles at once are what one
task holds.  The clicks of one client settle in one task by their nature (each needs the credit that the one before
left), at about 40 bytes and half a microsecond a click.

Defined results: rows equal in all columns count once; rows without ts or client_id give nothing; a click without
arrived_at counts as of the first hour, and if no click has one all are of the first batch; a null click_id settles
before the others of its instant; other columns only tell rows apart; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import _OURS, _delete, partitions, shared_dir

#: Microseconds that a click costs; credits are at most this many costs; allowance of the watermark.
COST, FULL, ALLOWANCE = 300 * 1_000_000, 12, 6 * 3600 * 1_000_000
#: Clicks of all batches that make one more bucket, and the least number of buckets.
BUCKET_CLICKS, LEAST_BUCKETS = 20_000, 16
#: Clicks that one task writes at least.
FILE_CLICKS = 100_000
#: Times before and after all others, and a click without id.
NEVER, EVER, NO_ID = -(1 << 63), (1 << 63) - 1, -(1 << 63)

CHECKSUMS = "spark.sql.streaming.checkpoint.fileChecksum.enabled"
#: No value of the stream's rows is null: beside a null, pandas would turn longs into doubles.
FEED = "bucket int, tick boolean, client long, at long, click long, w long, batch int"
SETTLED = "click_id long, outcome string, batch int, credit_after long, penalty_start_us long, penalty_end_us long"


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        since = column - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(column)


# Packed columns: the first value and the differences of int64 columns, their bytes by significance, compressed.

def packed(columns: list[np.ndarray]) -> bytes:
    parts = [struct.pack("<HI", len(columns), len(columns[0]))]
    for c in columns:
        with np.errstate(over="ignore"):
            steps = np.diff(c.astype(np.int64), prepend=np.int64(0))
        zigzag = (steps.view(np.uint64) << np.uint64(1)) ^ (steps >> np.int64(63)).view(np.uint64)
        parts.append(np.ascontiguousarray(zigzag.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n_columns, n = struct.unpack_from("<HI", raw)
    out = []
    for k in range(n_columns):
        planes = np.frombuffer(raw, np.uint8, 8 * n, 6 + 8 * n * k).reshape(8, n)
        zigzag = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
        steps = (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
        with np.errstate(over="ignore"):
            out.append(np.cumsum(steps, dtype=np.int64))
    return out


class Bucket:
    """Credits of a bucket's clients (id, last settled time, credit, start of the open penalty) and its waiting clicks
    (client, time, click)."""

    def __init__(self, credits: bytes | None = None, waiting: bytes | None = None):
        self.credits = unpacked(credits) if credits else [np.zeros(0, np.int64)] * 4
        self.waiting = unpacked(waiting) if waiting else [np.zeros(0, np.int64)] * 3

    def state(self) -> tuple[bytes, bytes]:
        return packed(self.credits), packed(self.waiting)

    def turn(self, own: list[np.ndarray], w: int, last: bool, cost: int, full: int) -> dict[str, np.ndarray]:
        """A batch of own clicks (client, time, click) at watermark w: the settled ones and the late ones."""
        late = own[1] < w
        late_clicks = own[2][late]
        held = [np.concatenate([x, y[~late]]) for x, y in zip(self.waiting, own)]
        due = np.ones(len(held[0]), bool) if last else held[1] < w
        client, at, click = (x[due] for x in held)
        order = np.lexsort((click, at, client))
        client, at, click = client[order], at[order], click[order]
        rest = [x[~due] for x in held]
        order = np.lexsort((rest[2], rest[1], rest[0]))
        self.waiting = [x[order] for x in rest]
        after, start, end = self._settle(client, at, cost, full)
        if w > NEVER:
            ids, since, credit, _ = self.credits
            stays = since + (full - credit) > w
            self.credits = [x[stays] for x in self.credits]
        throttled = start != NEVER
        return {"click": np.append(click, late_clicks), "kind": np.append(np.where(throttled, 1, 0), np.full(len(late_clicks), 2)),
                "after": np.append(after, np.zeros(len(late_clicks), np.int64)), "start": np.append(start, np.full(len(late_clicks), NEVER)),
                "end": np.append(end, np.full(len(late_clicks), NEVER))}

    def _settle(self, client: np.ndarray, at: np.ndarray, cost: int, full: int):
        """Credits after the clicks (sorted by client and time), and begin and end of the penalty of throttled ones."""
        n = len(client)
        after, start, end = np.zeros(n, np.int64), np.full(n, NEVER), np.full(n, NEVER)
        if not n:
            return after, start, end
        head = np.flatnonzero(np.append(True, client[1:] != client[:-1]))
        ids, since, had, opened = self.credits
        place = np.searchsorted(ids, client[head])
        known = place < len(ids)
        known[known] = ids[place[known]] == client[head][known]
        new_since, new_credit, new_open = [], [], []
        times = at.tolist()
        afters, starts, ends = [0] * n, [NEVER] * n, [NEVER] * n
        for a, b, k, there in zip(head.tolist(), np.append(head[1:], n).tolist(), place.tolist(), known.tolist()):
            if there:
                before, credit, penalty = int(since[k]), int(had[k]), int(opened[k])
            else:
                before, credit, penalty = times[a], full, NEVER
            for i in range(a, b):
                t = times[i]
                credit += t - before
                before = t
                if credit > full:
                    credit = full
                if credit >= cost:
                    credit -= cost
                    penalty = NEVER
                else:
                    if penalty == NEVER:
                        penalty = t
                    starts[i] = penalty
                    ends[i] = t + cost - credit
                afters[i] = credit
            new_since.append(before), new_credit.append(credit), new_open.append(penalty)
        stay = np.ones(len(ids), bool)
        stay[place[known]] = False
        merged = [np.concatenate([x[stay], np.array(y, np.int64)]) for x, y in zip(self.credits, (client[head], new_since, new_credit, new_open))]
        order = np.argsort(merged[0], kind="stable")
        self.credits = [x[order] for x in merged]
        return np.array(afters, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def _stateful(cost: int, full: int, last: int):
    outcomes = np.array(["admitted", "throttled", "late"], object)

    def step(key, frames, state):
        clicks, w, batch = [[], [], []], NEVER, 0
        for pdf in frames:
            tick = pdf["tick"].to_numpy(bool)
            for at in np.flatnonzero(tick)[:1]:
                w, batch = int(pdf["w"].to_numpy()[at]), int(pdf["batch"].to_numpy()[at])
            for held, name in zip(clicks, ("client", "at", "click")):
                held.append(pdf[name].to_numpy()[~tick])
        own = [np.concatenate([np.zeros(0, np.int64), *x]) for x in clicks]
        bucket = Bucket(*state.get) if state.exists else Bucket()
        out = bucket.turn(own, w, batch == last, cost, full)
        state.update(bucket.state())
        if len(out["click"]):
            yield pd.DataFrame({"click_id": out["click"], "outcome": outcomes[out["kind"]], "batch": np.full(len(out["click"]), batch, np.int32),
                                "credit_after": out["after"], "penalty_start_us": out["start"], "penalty_end_us": out["end"]})
    return step


def cut(clicks: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """Client, time and id of the clicks that count (equal rows once), and their batch by hour of arrival; and how many
    they are, with repeats."""
    kinds = {f.name: f.dataType for f in clicks.schema.fields}
    usable = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    hour = F.floor(micros(F.col("arrived_at"), kinds["arrived_at"]) / F.lit(3_600_000_000))
    lo, hi, n = usable.agg(F.min(hour), F.max(hour), F.count("*")).first()
    number = F.lit(0)
    if lo is not None:
        number = F.coalesce(F.floor((hour - lo) * batches / F.lit(hi - lo + 1)).cast("int"), F.lit(0))
    bumped = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return usable.distinct().select(
        F.col("client_id").cast("long").alias("client"), micros(F.col("ts"), kinds["ts"]).alias("at"),
        F.coalesce(F.col("click_id").cast("long"), F.lit(NO_ID)).alias("click"), F.least(number + bumped.cast("int"), F.lit(batches - 1)).cast("int").alias("batch")), n


def settle(clicks: DataFrame, batches: int = 10, cost: int = COST, full: int = FULL, allowance: int = ALLOWANCE, bucket_clicks: int = BUCKET_CLICKS) -> DataFrame:
    """Per click: click_id, outcome (admitted, throttled or late), batch, credit_after, penalty_start_us, penalty_end_us.

    The batches are written to a new folder under spark.checkpoint.dir, and are shown to the stream one after another;
    the stream is started anew for each, on one checkpoint."""
    spark = clicks.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/throttle-{uuid.uuid4().hex}"
    _OURS.append((spark, folder))
    counted, n = cut(clicks, batches)
    parts = partitions(spark)
    buckets = max(LEAST_BUCKETS, -(-n // bucket_clicks))
    rows = counted.select(F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("tick"), "client", "at", "click", F.lit(NEVER).alias("w"), "batch")
    # every task writes a file for each batch, so short tables go through few tasks
    rows.coalesce(max(LEAST_BUCKETS, n // FILE_CLICKS)).withColumn("part", F.col("batch")).write.partitionBy("part").parquet(f"{folder}/cut")
    feed = T.StructType.fromDDL(FEED)
    tops = {r.part: r.top for r in spark.read.schema(T.StructType.fromDDL(f"{FEED}, part int")).parquet(f"{folder}/cut").groupBy("part").agg(F.max("at").alias("top")).collect()}  # a row for each batch
    w = NEVER
    for b in range(batches):
        nothing = F.lit(0).cast("long")
        ticks = spark.range(0, buckets, 1, min(parts, -(-buckets // 1000))).select(
            F.col("id").cast("int").alias("bucket"), F.lit(True).alias("tick"), nothing.alias("client"), nothing.alias("at"), nothing.alias("click"), F.lit(w).cast("long").alias("w"), F.lit(b).alias("batch"))
        _show(spark, f"{folder}/cut/part={b}", f"{folder}/feed/{b}")
        ticks.write.mode("append").parquet(f"{folder}/feed/{b}")
        _run(spark, folder, feed, _stateful(cost, full * cost, batches - 1))
        if tops.get(b) is not None:
            w = max(w, tops[b] - allowance)
    for done in ("cut", "feed", "checkpoint"):
        _delete(spark, f"{folder}/{done}")
    told = lambda name, when: F.when(when, F.col(name)).alias(name)
    throttled = F.col("outcome") == "throttled"
    return spark.read.schema(SETTLED).parquet(f"{folder}/settled").select(
        told("click_id", F.col("click_id") != NO_ID), "outcome", "batch", told("credit_after", F.col("outcome") != "late"), told("penalty_start_us", throttled), told("penalty_end_us", throttled))


def _show(spark: SparkSession, path: str, to: str) -> None:
    """Moves a written batch (if it has rows) to where the stream looks for its next one."""
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(there.getParent())
    if fs.exists(here) and not fs.rename(here, there):
        raise OSError(f"{path} can't be moved to {to}")


def _run(spark: SparkSession, folder: str, feed: T.StructType, step) -> None:
    """One start of the stream, over what is there and new to its checkpoint."""
    kept = spark.conf.get(CHECKSUMS, None)
    spark.conf.set(CHECKSUMS, "false")  # the checkpoint ends with this call, and a small file beside each file doubles its writes
    query = (spark.readStream.schema(feed).parquet(f"{folder}/feed/*").groupBy("bucket")
             .applyInPandasWithState(step, SETTLED, "credits binary, waiting binary", "append", "NoTimeout")
             .writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/settled")
             .outputMode("append").trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset(CHECKSUMS)
        else:
            spark.conf.set(CHECKSUMS, kept)
