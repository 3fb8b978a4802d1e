"""Importance resampling against plain Python: every run's bucket, gains, noise and ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rulelake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def runs(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def bucket(run, buckets):
    return zlib.crc32(run.encode()) % buckets


def brute(rows, items, n=1, buckets=10_000, least=20, percent=10):
    s, t = Counter(), Counter()
    for texts, c in (((r[1] for r in rows), s), (items, t)):
        for text in texts:
            c.update(bucket(x, buckets) for x in runs(text, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in set(s) | set(t)}
    out = []
    for i, text in rows:
        words, own = runs(text, n)
        weight = sum(gain[bucket(x, buckets)] for x in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    drawn = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0], x[2], x[1]))
    for k, x in enumerate(drawn[:len(drawn) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def result(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    return sorted((tuple(r) for r in resample.resample(docs, target, **more).collect()), key=repr)


def corpus(n=200, seed=1):
    r = random.Random(seed)
    vocab = ["Stone", "wäter", "x1", "the", "of", "日本", "a", "Ünder"]
    text = lambda: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "_", "\x7f"]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice([i, i, i - 1, (1 << 53) + i]), r.choice([text(), text(), text(), None, ""])) for i in range(n)]
    rows += rows[:15] + [(None, text()), (None, "the " * 30), (None, "the " * 30), (n, "long " + "the of " * 70_000)]
    return rows, [text() for _ in range(20)]


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (3, 97, 50), (2, 100_000, 100)])
def test_against_plain_python(spark, n, buckets, percent):
    rows, items = corpus()
    got = result(spark, rows, items, n=n, buckets=buckets, percent=percent)
    assert got == brute(rows, items, n, buckets, percent=percent) and any(x[4] for x in got)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_the_ring_goes_on_between_stretches(n):
    words = [w.encode() for w in "a bb ccc a dd e ff g".split()]
    want = sorted(zlib.crc32(b" ".join(words[i:i + k])) for k in range(1, n + 1) for i in range(len(words) - k + 1))
    for stretch in (1, 2, 3, 100):
        assert sorted(np.concatenate(list(resample.ring(words, n, stretch))).tolist()) == want


def test_empty_tables(spark):
    assert result(spark, [], ["a b"]) == []
    rows = [(1, "a " * 30), (2, "b " * 30)]
    assert result(spark, rows, [], percent=50) == brute(rows, [], percent=50)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * 9, 1, "x") for i in range(20)], "doc_id long, text string, weight long, place string")
    assert [r.rank for r in resample.resample(docs, docs).orderBy("rank").collect() if r.rank] == [1, 2]
