"""Attention over passages: features against plain Python, the gradient against differences, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest

from rulelake.llm import instances as I

SCHEMA = "doc_id long, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text, size):
    """Passages of a text: class shares and repetition, without the projection."""
    text = text or ""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    heads = [0] + [a for k, (a, _) in enumerate(words) if k % size == 0 and k]
    lines, line_at, seen_lines, dup = text.split("\n"), 0, set(), {}
    for line in lines:
        if WORD.search(line):
            if line in seen_lines:
                dup[line_at] = len(line.encode())
            seen_lines.add(line)
        line_at += len(line) + 1
    out, seen, kinds = [], set(), {}
    for k in range(len(words) - 2):
        run = tuple(text[a:b] for a, b in words[k:k + 3])
        kinds[k] = run in seen
        seen.add(run)
    for i, (a, b) in enumerate(zip(heads, heads[1:] + [len(text)])):
        own = range(i * size, min((i + 1) * size, len(words)))
        data = text[a:b].encode()
        n = max(len(data) + (b == len(text)), 1)
        shares = np.bincount([I.CLASSES[c] for c in data], minlength=I.N_CLASSES) / n
        out.append((np.sqrt(shares), sum(k > 0 and text[slice(*words[k])] == text[slice(*words[k - 1])] for k in own) / max(len(own), 1),
                    sum(kinds.get(k, False) for k in own) / max(len(own), 1), min(1, sum(v for p, v in dup.items() if a <= p < b) / n)))
    return out


def texts(seed=2, n=60):
    r = random.Random(seed)
    out = [None, "", " \n ", "one", "\n\nb"]
    for _ in range(n):
        line = lambda: " ".join(r.choice(["Stone", "wäter", "a", "##", "日本", "42,"]) for _ in range(r.randint(0, 9)))
        lines = [line() for _ in range(4)]
        out.append("\n".join(r.choice(lines) for _ in range(r.randint(1, 12))))
    return out


@pytest.mark.parametrize("size", [4, 128])
def test_features_against_plain_python(size):
    some = texts()
    x, bags = I.encode(some, size)
    for i, text in enumerate(some):
        want = plain(text, size)
        got = x[bags[i]:bags[i + 1]]
        assert len(got) == len(want)
        for row, (shares, same, again, dup) in zip(got, want):
            assert np.allclose(row[:I.N_CLASSES], shares, atol=1e-6) and np.allclose(row[[-6, -5, -4]], [same, again, dup], atol=1e-6)
    parts = [I.encode([t], size)[0] for t in some]
    assert np.allclose(np.concatenate(parts), x, atol=1e-4)


def test_the_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    x, bags, y, w = r.normal(size=(9, 5)), np.array([0, 1, 5, 9]), np.array([0, 1, 1.0]), np.array([1, 2, 0.5])
    net = I.Network(np.zeros(5), np.ones(5))
    net.p = {k: r.normal(size=v.shape) * 0.5 for k, v in net.p.items()}

    def loss():
        s = net.forward(x, bags)["score"]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    for k, g in net.gradient(x, bags, y, w).items():
        for i in np.ndindex(g.shape):
            kept = net.p[k][i]
            net.p[k][i] = kept + 1e-6
            high = loss()
            net.p[k][i] = kept - 1e-6
            low = loss()
            net.p[k][i] = kept
            assert abs((high - low) / 2e-6 - g[i]) < 1e-5


def labelled(n=400, seed=5):
    """Bad documents have one bad passage among good ones: only attention can tell."""
    r = random.Random(seed)
    good = lambda k: " ".join(r.choice(["stone", "water", "light", "green", "winter", "with", "of"]) for _ in range(k))
    bad = lambda k: " ".join(r.choice(["ston#", "WAT$$", "l|ght"]) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        passages = [good(128) for _ in range(r.randint(1, 8))]
        label = r.random() < 0.6
        if not label:
            passages[r.randrange(len(passages))] = bad(128)
        rows.append((i, " ".join(passages)))
        labels.append((i, int(label), 0))
    return rows, labels


def test_held_out_accuracy_and_attention(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = I.scores(docs, I.train(docs, marks), with_attention=True).collect()
    label, text = {i: q for i, q, _ in labels}, dict(rows)
    held = [r for r in out if r.held_out]
    assert sorted(r.doc_id for r in held) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.97
    found = [("#" in " ".join(text[r.doc_id].split()[128 * r.top_passage:128 * (r.top_passage + 1)])) for r in held if not label[r.doc_id] and r.n_passages > 1]
    assert sum(found) / len(found) > 0.9
    assert all(abs(sum(r.attention) - 1) < 1e-9 and len(r.attention) == r.n_passages and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_defined_results(spark):
    rows, labels = labelled(60)
    rows += [(None, None), ((1 << 53) + 1, ""), ((1 << 53) + 1, ""), (7, "again"), (1000, "x" * 300_000), (1001, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t in rows], "doc_id long, text string, label string, id double")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5, 1 - labels[5][1], 0), (6, 2, 0)], "doc_id long, quality int, toxic int")
    out = I.scores(docs, I.train(docs, marks, sample=20)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None) and len(out) == len(rows)
    assert len({r.score for r in out if r.doc_id == (1 << 53) + 1 or r.doc_id is None}) == 1 and [r.held_out for r in out if r.doc_id is None] == [False]
    assert {r.score for r in I.scores(docs, I.train(docs, marks.limit(0))).collect()} == {0.5}
    assert I.scores(docs.limit(0), None).collect() == []
