import heapq
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from rulelake.llm import lengths, packing, tokens

SCHEMA = "doc_id long, text string, source string, queue string, at int"


def docs(n=60, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé漢'1 ", k=r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.choice([0, 1, 5, 80, 400]))), r.choice(["a"] * 5 + ["b", "c", None]), "x", 1) for i in range(n)]
    return [*rows, (n, None, "a", "x", 1), (n + 1, "", "b", "x", 1), (n + 2, "long " * 9000, "c", "x", 1), (0, *rows[0][1:])]


def test_ids_equal_the_library():
    t = Tokenizer.from_file(tokens.vocabulary())
    e = tokens.Encoder(tokens.vocabulary())
    r = random.Random(1)
    chars = "ab 's'tre'll \n\t　  é漢字1²½٣_-<>|endoftext|'dmve  𝒳🙂"
    texts = ["".join(r.choices(chars, k=r.randint(0, 60))) for _ in range(3000)] + ["x<|endoftext|>y", None, "", " ", "  a", "'s", "\n's", "a  "]
    ids, at = e.ids(texts)
    for i, s in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == t.encode(s or "", add_special_tokens=False).ids, repr(s)


def test_word_table_is_emptied_when_full(monkeypatch):
    e = tokens.Encoder(tokens.vocabulary())
    e.table = tokens.WordTable(1 << 10)
    whole = tokens.Encoder(tokens.vocabulary())
    for k in range(20):
        texts = [f"w{k}x{i} y{i * k}" for i in range(60)]
        assert np.array_equal(e.ids(texts)[0], whole.ids(texts)[0])


def test_one_text_with_more_words_than_the_table_holds():
    whole, e = tokens.Encoder(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    e.table = tokens.WordTable(1 << 8)
    texts = ["short one", None, " ".join(str(10**6 + 7919 * i) for i in range(3000)), "", "the end"]
    for _ in range(2):
        for got, want in zip(e.ids(texts), whole.ids(texts)):
            assert np.array_equal(got, want)
    assert e.ids(texts)[0].tolist() == [x for t in texts for x in e.tokenizer.encode(t or "", add_special_tokens=False).ids]


@pytest.mark.parametrize("totals,weights", [([5000, 700, 1], [5000, 700, 1]), ([300, 3000, 9000], [1, 1, 1]), ([1000], [7]), ([640, 640], [3, 5])])
def test_schedule_is_the_sequential_round_robin(totals, weights):
    s = packing.Schedule(np.array(totals), np.array(weights), 128, 1024)
    heap = [((1) / w, i, 0) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    at = 0
    while heap:
        _, i, j = heapq.heappop(heap)
        n = min(128, totals[i] - 128 * j)
        if n > 0:
            assert s.places(np.array([i]), np.array([j]))[0] == at
            at += n
            heapq.heappush(heap, ((2 * j + 3) / weights[i], i, j + 1))
    assert at == sum(totals)


@pytest.mark.parametrize("seed,n,equal", [(1, 700, False), (2, 300, True), (3, 40, False)])
def test_many_queues_have_the_places_of_the_sequential_round_robin(seed, n, equal):
    r = np.random.default_rng(seed)
    totals = r.integers(1, 6000, n) * r.choice([1, 1, 20], n)
    weights = np.full(n, 7) if equal else np.maximum(1, r.integers(1, 1 << 20, n) // r.choice([1, 1000], n))
    s = packing.Schedule(totals, weights, 128, 1024, max_queues=16)
    queue = np.repeat(np.arange(n), s.slots)
    slot = np.concatenate([np.arange(x) for x in s.slots])
    order = sorted(range(len(slot)), key=lambda i: (Fraction(int(2 * slot[i] + 1), int(weights[queue[i]])), queue[i]))
    size = np.minimum(128, totals[queue] - 128 * slot)[order]
    want = np.empty(len(slot), np.int64)
    want[order] = np.cumsum(size) - size
    assert np.array_equal(s.places(queue, slot), want)
    for pick in (r.permutation(len(slot))[:500], np.flatnonzero(queue == 3), np.array([5])):
        assert np.array_equal(s.places(queue[pick], slot[pick]), want[pick])


def test_each_of_many_sources_keeps_its_target(spark):
    names = [f"s{i}" for i in range(300)]
    rows = [(i * 40 + k, "a b c d e f g h i j k l m n o" * 60, x, "x", 1) for i, x in enumerate(names) for k in range(3 if i else 40)]
    rows += [(20_000, "null source", None, "x", 1), (20_001, "empty source", "", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), targets=dict.fromkeys(names, 1.0) | {"s0": 100.0}).collect()
    assert {r.queue for r in got} == {*names, ""}
    early = [r for r in got if r.sequence_id < 30]
    share = sum(r.length for r in early if r.queue == "s0") / sum(r.length for r in early)
    assert share == pytest.approx(100 / (100 + 299 + 2), abs=0.05)


@pytest.mark.parametrize("targets,queues", [(None, 256), ({"a": 0.2, "b": 0.5, "c": 0.3}, 256), (None, 2)])
def test_packing_covers_every_id_once(spark, targets, queues):
    rows = docs()
    t = Tokenizer.from_file(tokens.vocabulary())
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), targets=targets, max_queues=queues).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        copies = len(want[i])
        assert all(p.doc_tokens == len(want[i][0]) for p in pieces)
        assert sum(p.length for p in pieces) == copies * len(want[i][0])
        if copies == 1:
            upto = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == upto
                upto += p.length
                assert p.ids_crc32 == zlib.crc32(np.array(want[i][0][p.start:upto], "<u4").tobytes())
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        upto = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == upto
            upto += p.length
        assert upto <= 1024 and upto & (upto - 1) == 0  # no padding at all
    if targets is None and queues > 2:
        total = sum(r.length for r in got)
        share = {q: sum(r.length for r in got if r.queue == q) / total for q in ("", "a", "b", "c")}
        full = [s for s in by_seq if sum(p.length for p in by_seq[s]) == 1024]
        served = dict.fromkeys(share, 0.0)
        for n, s in enumerate(sorted(full), 1):
            for p in by_seq[s]:
                served[p.queue] += p.length
            assert all(abs(served[q] - share[q] * 1024 * n) <= 2 * 128 + 1 for q in share)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).collect() == [] and lengths.suffix_sums(lengths.histogram(none)).collect() == []


def test_lengths(spark):
    rows = docs(40, 8)
    t = Tokenizer.from_file(tokens.vocabulary())
    n = sorted(len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame(rows, SCHEMA)), span=64)
    got = sums.collect()
    assert sorted(r.length for r in got) == sorted(set(n))
    for r in got:
        assert r.n_docs == n.count(r.length) and r.docs_at_least == sum(x >= r.length for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.length) and r.docs_at_most == sum(x <= r.length for x in n)
        assert r.tokens_if_cut_here == sum(min(x, r.length) for x in n) and r.tokens_lost == sum(n) - r.tokens_if_cut_here
    q = {r.level: r.length for r in lengths.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    assert q == {p: n[max(1, int(np.ceil(p * len(n)))) - 1] for p in q} and len(q) == 5
    cut = {r.max_tokens: (r.docs_cut, r.tokens_kept) for r in lengths.limits(sums, [0, 3, 100, 10**6]).collect()}
    assert cut == {m: (sum(x > m for x in n), sum(min(x, m) for x in n)) for m in cut} and len(cut) == 4


def test_the_query_fills_windows_to_unequal_targets(spark):
    from collections import Counter, defaultdict

    from rulelake.llm import queries

    pieces = queries.op1_mixture_packing(spark, "/root/testdata/sf0.001").collect()
    total, by_window = Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.queue] += p.length
        by_window[p.sequence_id][p.queue] += p.length
    weight = {q: queries.TARGETS.get(q, 1.0) for q in total}
    # until the first queue runs dry every window holds the targets to within two slots of 128 tokens
    dry = min(total[q] / weight[q] for q in total) * sum(weight.values()) // 1024
    assert dry >= 3 and len(set(weight.values())) == 4
    for n in range(int(dry) - 1):
        for q in total:
            assert abs(by_window[n][q] - 1024 * weight[q] / sum(weight.values())) <= 256, (n, q)
