import hashlib
import random
import re

import pytest

from rulelake.llm import decontaminate, storage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id long"


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for item, t in items:
            v = _words(t)
            if item is None or not v:
                continue
            n = min(10, len(v))
            for j in range(len(v) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == v[j:j + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def cases(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "cé", "d9", "Ee", "über"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 7, 9, 10, 11, 30]))) for i in range(12)] + [(3, None), (None, text(12)), (5, text(14))]
    docs = [(i, text(r.randint(0, 60))) for i in range(30)]
    for i in range(30, 60):
        a, b = r.choice(items)[1] or "", r.choice(items)[1] or ""
        docs.append((i, text(r.randint(0, 9)) + a + " " + text(r.randint(0, 5)) + b[r.randint(0, 20):]))
    return [*docs, (60, None), (61, ""), (62, " \n"), (63, text(9000)), (64, items[7][1]), (65, items[7][1])], items


@pytest.mark.parametrize("seed, few", [(1, False), (2, False), (3, True)])
def test_against_brute_force(spark, monkeypatch, seed, few):
    if few:  # a full bitmap, and a join that is not broadcast
        monkeypatch.setattr(decontaminate, "MOST_BITS", 3)
        monkeypatch.setattr(decontaminate, "LEAST_BITS", 3)
        monkeypatch.setattr(storage, "is_small", lambda *a: False)
    docs, items = cases(seed)
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], SCHEMA)  # item_id clashes on purpose
    b = spark.createDataFrame([(7, t, i) for i, t in items], SCHEMA)
    rows = decontaminate.contamination(d, b).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert len(rows) == len(docs) and got == brute(docs, items)


def test_empty_tables(spark):
    d, none = spark.createDataFrame([(1, "a b c", 1), (None, "x", 1)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert {r.n_hit for r in decontaminate.contamination(d, none).collect()} == {0}
    assert decontaminate.contamination(none, d).collect() == []


def test_null_and_repeated_ids(spark):
    docs, items = cases(4)
    docs = [(None if i % 3 else 7, t) for i, t in docs]  # null and repeated ids with different texts
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], SCHEMA)
    b = spark.createDataFrame([(7, t, i) for i, t in items], SCHEMA)
    plain = lambda rows: sorted(map(repr, rows))
    want = plain((i, *brute([(0, t)], items)[0]) for i, t in docs)
    assert plain(tuple(r) for r in decontaminate.contamination(d, b).collect()) == want
    kept = decontaminate.clean(d, b).collect()
    assert plain(tuple(r) for r in kept) == plain((i, t, 1) for i, t in docs if not brute([(0, t)], items)[0][4])
