import random
import re

import numpy as np
import pytest

from rulelake.llm import components, signature
from rulelake.llm import kernels as K

SCHEMA = "doc_id long, text string, n_shingles string, component_id int"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is None or b is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i) if s else i) for i, s in sets if i is not None}


def docs(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "x-y"]
    bases = [r.choices(vocab, k=r.choice([4, 9, 12, 20, 40, 90, 200])) for _ in range(12)]
    shared = r.choices(vocab, k=30)
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(w))
            w[k:k + r.choice([0, 1])] = r.choices(vocab, k=r.choice([0, 1]))
        if r.random() < 0.1:
            w = [*w[:10], *shared]
        if r.random() < 0.1:
            w += shared[:r.randint(1, 3)]
        out.append((i * 3 % 361, " ".join(w).upper() if r.random() < 0.1 else "  ".join(w)))
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a b"), (1006, out[0][1]),
            (None, out[0][1]), (1007, "long " + " ".join(r.choices(vocab, k=20_000)))]


@pytest.mark.parametrize("seed,size,percent,block,segments", [(1, 3, 90, 2_000_000, None), (2, 3, 90, 300, False), (3, 5, 80, 2_000_000, True), (4, 5, 80, 200, None), (5, 2, 50, 400, None)])
def test_against_brute_force(spark, seed, size, percent, block, segments):
    data = docs(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA).repartition(5)
    rows = signature.similar_groups(df, size, percent, block, segments).collect()
    assert len(rows) == len(data)
    want = brute(data, size, percent)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_pigeonhole_keys_meet_for_every_similar_pair():
    r = np.random.default_rng(7)
    for percent in (50, 80, 90):
        sizes = signature.Sizes(percent)
        for _ in range(400):
            n = int(r.integers(2, 120))
            a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            drop, add = int(r.integers(0, n // 3 + 1)), int(r.integers(0, n // 3 + 1))
            b = np.concatenate([a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)])
            inter, union = n - drop, n + add
            if 100 * inter < percent * union or not len(b) or (drop == add == 0):
                continue
            grams = np.concatenate([np.sort(a), np.sort(b)])
            keys, owner = signature.segment_keys(grams, np.array([0, n, n + len(b)]), sizes)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_prefixes_of_similar_sets_share_enough():
    r = np.random.default_rng(8)
    weights = r.integers(0, 4, 1 << signature.SLOT_BITS).astype(np.uint8)
    for percent in (60, 80):
        sizes = signature.Sizes(percent)
        for _ in range(300):
            n = int(r.integers(1, 150))
            a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            drop, add = int(r.integers(0, n // 4 + 1)), int(r.integers(0, n // 4 + 1))
            b = np.concatenate([a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)])
            if 100 * (n - drop) < percent * (n + add):
                continue
            keys, owner = signature.prefix_keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, n + len(b)]), sizes, weights)
            shared = set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
            assert len(shared) >= max(1, min(n, len(b)) // signature.SHARED)


def test_small_groups_make_pairs_and_large_ones_ties():
    keys = np.array([5, 5, 5, 7, 7, 9, 5, 5, 7, 7], np.uint64)
    docs = np.array([1, 2, 3, 1, 2, 4, 4, 3, 2, 9], np.int64)
    m = signature.Meeting(keys, docs, np.zeros(10, np.uint8), 3)
    assert m.ties().tolist() == [[2, 1], [3, 1], [4, 1]]
    some, bucket, n = m.pairs()
    assert some.tolist() == [[2, 1], [9, 1], [9, 2]] and n.tolist() == [1, 1, 1] and bucket.tolist() == [0, 0, 0]


def test_groups_hang_together_along_sizes_only():
    keys, docs = np.full(6, 5, np.uint64), np.array([6, 5, 4, 3, 2, 1], np.int64)
    m = signature.Meeting(keys, docs, np.array([1, 2, 3, 7, 8, 8], np.uint8), 3)
    assert m.ties().tolist() == [[2, 1], [3, 1], [5, 4], [6, 4]]
    some, bucket, _ = signature.Meeting(keys, docs, np.array([1, 2, 3, 7, 8, 8], np.uint8), 8).pairs()
    assert some.tolist() == [[2, 1], [3, 1], [3, 2], [5, 4], [6, 5]] and bucket.tolist() == [8, 7, 7, 2, 1]
    many = signature.Meeting(np.full(50, 5, np.uint64), np.arange(50), np.repeat([1, 9], 25).astype(np.uint8), 3)
    assert many.docs[many.to_send()].tolist() == [0, 1, 2, 3, 25]


def test_tree_loses_no_link():
    r = np.random.default_rng(3)
    sizes = signature.Sizes(80)
    for _ in range(20):
        sets = []
        for _ in range(8):
            base = r.integers(0, 1 << 63, int(r.integers(8, 60)), dtype=np.uint64)
            for _ in range(int(r.integers(1, 9))):
                s = base[r.random(len(base)) > 0.1]
                sets.append(np.sort(np.unique(np.concatenate([s, r.integers(0, 1 << 63, int(r.integers(0, 4)), dtype=np.uint64)]))))
        cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = signature.block_links(np.concatenate(sets), cut, np.arange(len(sets)), np.arange(len(sets)), sizes)
        want, got = np.arange(len(sets)), np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                    want[want == want[a]] = want[b]
        for a, b in links:
            got[got == got[a]] = got[b]
        pairs = lambda x: x[:, None] == x
        assert (pairs(want) == pairs(got)).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).df.collect() == []


def test_one_of_each_group_stays(spark):
    data = docs(9)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA)
    kept = signature.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute([d for d in data if d[0] is not None], 5, 80)
    assert sorted(x for x in ids if x is not None) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)
    assert ids.count(None) == 1


def test_rows_of_one_id_and_different_texts_are_told_apart(spark):
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=40))
    one, two, three = text(1), text(2), text(3)
    schema = "doc_id long, text string, full string, key map<string,int>, n_shingles string, twice int, id int"
    rows = [(1, one, "a", {"x": 1}), (1, two, "b", None), (1, two, "b", None), (2, one + " end", "c", None), (3, two, "d", None), (4, three, "e", None), (4, None, "f", None),
            (4, None, "f", None), (5, three + " end", "g", None), (None, three, "h", None), (0, "begin " + three, "i", None)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    kept = signature.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.full) for r in kept.collect())
    assert got == sorted([("1", "a"), ("1", "b"), ("4", "f"), ("4", "f"), ("None", "h"), ("0", "i")])


def test_empty_table_and_ties(spark):
    assert signature.similar_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    grams, cut = K.word_shingles(*K.buffer(["a b a b a b", "a"]), 2)
    assert np.diff(cut).tolist() == [2, 1]


def test_without_broadcasts(spark, monkeypatch):
    from rulelake.llm import packing, repeats, storage

    data = docs(11, 60)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA).repartition(3)
    texts = df.withColumnRenamed("n_shingles", "source")
    before = [sorted(map(tuple, f.collect()), key=repr) for f in (signature.similar_groups(df, 3, 90), repeats.remove_repeats(df), packing.pack(texts))]
    monkeypatch.setattr(storage, "is_small", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = [sorted(map(tuple, f.collect()), key=repr) for f in (signature.similar_groups(df, 3, 90), repeats.remove_repeats(df), packing.pack(texts))]
        ids = {r.doc_id for r in signature.one_of_each(df, 5, 80).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert after == before
    want = brute([d for d in data if d[0] is not None], 5, 80)
    assert ids - {None} == {i for i, (n, c) in want.items() if n == 0 or c == i}


def test_bytes_count_against_a_broadcast(spark):
    from rulelake.llm import storage

    rows = spark.range(50).selectExpr("id", "repeat('x', 1000) AS t", "array(id, id) AS a", "array('yy', t) AS s")
    assert storage.is_small(rows) and not storage.is_small(rows, rows=49) and not storage.is_small(rows, size=100_000) and storage.is_small(rows, size=110_000)
