import hashlib
import random

import numpy as np
import pytest

from rulelake.llm import repeats

SCHEMA = "doc_id long, text string, cuts string, n int"


def brute(docs, span=100):
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            w = b[k:k + span]
            if w in seen:
                gone[k:k + span] = True
            else:
                seen[w] = (i, k)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def docs(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé漢 ", k=r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.choice([18, 25, 60])) for _ in range(6)]
    out = []
    for i in range(70):
        parts = [text(r.randint(0, 30)) for _ in range(3)]
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(len(p) // 3)
            parts.insert(r.randrange(3), p[a:a + r.randint(40, 400)])
        out.append((r.randrange(10**6), "".join(parts)))
    out = list(dict(out).items())
    base = out[0][1]
    return [*out, (2_000_001, base), (2_000_002, base[:50] + "X" + base[51:]), (2_000_003, None), (2_000_004, ""), (2_000_005, "a" * 99),
            (2_000_006, "a" * 350), (2_000_007, "b" * 120 + "a" * 100 + "ab" * 130), (2_000_008, (passages[0] + "q") * 4), (-5, passages[1]),
            (2_000_009, text(3000) + base)]


@pytest.mark.parametrize("seed,hot,flush", [(1, 50_000, 2_000_000), (2, 1, 40), (3, 3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, hot, flush):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    data = docs(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA).repartition(4)
    rows = repeats.remove_repeats(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(data)
    want = brute(data)
    assert got == want, [(i, got[i], want[i]) for i in got if got[i] != want[i]]
    assert sum(w[1] for w in want.values()) > 5000


def test_refinement_is_exact():
    r = np.random.default_rng(1)
    buf = r.integers(0, 2, 3000).astype(np.uint8)
    for span in (8, 11, 20):
        at = np.arange(len(buf) - span + 1)
        left, interval = repeats.refine(buf, at, np.zeros(len(at), np.int64), span)
        words = {}
        for k in at:
            words.setdefault(bytes(buf[k:k + span]), []).append(k)
        want = sorted(v for v in words.values() if len(v) > 1)
        got = {}
        for k, i in zip(left.tolist(), interval.tolist()):
            got.setdefault(i, []).append(k)
        assert sorted(sorted(v) for v in got.values()) == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, text, "x", 1), (1, text, "x", 1), (None, text, "x", 1), (2, text, "x", 1)], SCHEMA)
    assert sorted((str(r.doc_id), r.n_removed) for r in repeats.remove_repeats(df).collect()) == [("1", 0), ("1", 0), ("2", 300), ("None", 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_anchors_do_not_depend_on_what_stands_around():
    r = np.random.default_rng(5)
    hashes = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    hashes[1500:1580] = hashes[100:180]
    for width in (1, 7, 60):
        got = repeats.least_places(hashes, width, 8)
        top = hashes >> np.uint64(8)
        assert got.tolist() == [i + int(top[i:i + width].argmin()) for i in range(len(hashes) - width + 1)]
