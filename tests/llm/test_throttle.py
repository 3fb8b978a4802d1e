"""Click throttling against a plain loop over all clicks, and its packed state."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelake.llm import throttle

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def brute(rows, batches=10, cost=300 * 10**6):
    rows = [r for r in dict.fromkeys(rows) if r[1] is not None and r[3] is not None]
    hours = [us(r[2]) // 3_600_000_000 for r in rows if r[2] is not None]
    lo, hi = (min(hours), max(hours)) if hours else (0, 0)
    cut = {}
    for r in rows:
        b = 0 if r[2] is None else (us(r[2]) // 3_600_000_000 - lo) * batches // (hi - lo + 1)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            b = min(b + 1, batches - 1)
        cut.setdefault(b, []).append((r[3], us(r[1]), -(1 << 63) if r[0] is None else r[0]))
    w, waiting, credits, out = None, [], {}, []
    for b in range(batches):
        own = cut.get(b, [])
        out += [(c, "late", b, None, None, None) for _, t, c in own if w is not None and t < w]
        waiting += [x for x in own if w is None or x[1] >= w]
        due = [x for x in waiting if b == batches - 1 or w is not None and x[1] < w]
        waiting = [x for x in waiting if not (b == batches - 1 or w is not None and x[1] < w)]
        for client, t, c in sorted(due):
            before, credit, since = credits.get(client, (t, 12 * cost, None))
            credit = min(12 * cost, credit + t - before)
            if credit >= cost:
                credit, since = credit - cost, None
                out.append((c, "admitted", b, credit, None, None))
            else:
                since = t if since is None else since
                out.append((c, "throttled", b, credit, since, t + cost - credit))
            credits[client] = (t, credit, since)
        if own:
            w = max(w if w is not None else -(1 << 63), max(t for _, t, _ in own) - 6 * 3600 * 10**6)
    return sorted(((None if c == -(1 << 63) else c, *rest) for c, *rest in out), key=repr)


def clicks(n, seed, hours=200):
    r, rows = random.Random(seed), []
    for i in range(n):
        client = r.choice([7, 7, 7, (1 << 53) + 1, (1 << 53), r.randint(0, 9), None if i % 31 == 0 else 3])
        ts = DAY + dt.timedelta(microseconds=r.randrange(hours * 3_600_000_000)) if r.random() < 0.5 else DAY + dt.timedelta(hours=r.choice([5, 90, 91]), seconds=r.randrange(4000))
        lag = r.choice([1, 1, 1, 3600, 20 * 3600, 80 * 3600])
        rows.append(((1 << 60) + i, None if i % 37 == 0 else ts, ts + dt.timedelta(seconds=lag), client, r.choice(["view", None]), 1.5, None))
    rows += rows[:20] + [(x[0], x[1], x[2], x[3], "other", None, "{}") for x in rows[20:30]]
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_clicks_against_a_plain_loop(spark):
    rows = clicks(1500, 3)
    got = result(throttle.settle(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket_clicks=100))
    assert got == brute(rows)
    assert {x[1] for x in got} == {"admitted", "throttled", "late"}


def test_nulls_ties_and_clashing_columns(spark):
    t = DAY + dt.timedelta(hours=3)
    rows = [(None, t, t, 1, None, None, None), (5, t, None, 1, None, None, None), (5, t, t, 1, "a", None, None), (6, t, t, 1, None, None, None),
            (7, None, t, 1, None, None, None), (8, t, t, None, None, None, None)] + [(100 + i, t, t + dt.timedelta(hours=i), 1, None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"bucket": F.lit("x"), "w": F.lit(1), "tick": F.lit(None).cast("string"), "client": F.lit(2.5)})
    assert result(throttle.settle(df, batches=3)) == brute(rows, batches=3)


def test_empty_table_and_no_arrivals(spark):
    assert throttle.settle(spark.createDataFrame([], SCHEMA), batches=2).collect() == []
    rows = [(i, DAY + dt.timedelta(seconds=i), None, 1, None, None, None) for i in range(30)]
    assert result(throttle.settle(spark.createDataFrame(rows, SCHEMA), batches=2)) == brute(rows, batches=2)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_a_zone_do_not_follow_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = dt.datetime(2024, 3, 10, 2, 30, 0, 17)  # does not exist in New York
        df = spark.createDataFrame([(at,)], "t timestamp_ntz")
        assert df.select(throttle.micros(df["t"], df.schema["t"].dataType)).first()[0] == us(at)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_packed_columns_come_back():
    r = np.random.default_rng(5)
    for n in (0, 1, 1000):
        columns = [r.integers(-(1 << 63), (1 << 63) - 1, n), np.sort(r.integers(0, 1 << 40, n)), np.full(n, -(1 << 63))]
        assert all((a == b).all() for a, b in zip(columns, throttle.unpacked(throttle.packed(columns))))


def test_full_credits_leave_the_state():
    bucket = throttle.Bucket()
    cost, full = 10, 120
    own = [np.array([1, 2]), np.array([100, 5000]), np.array([1, 2])]
    bucket.turn(own, throttle.NEVER, False, cost, full)
    assert len(bucket.waiting[0]) == 2 and not len(bucket.credits[0])
    none = [np.zeros(0, np.int64)] * 3
    bucket.turn(none, 105, False, cost, full)
    assert bucket.credits[0].tolist() == [1] and bucket.waiting[0].tolist() == [2]
    bucket = throttle.Bucket(*bucket.state())
    bucket.turn(none, 111, False, cost, full)
    assert not len(bucket.credits[0])
