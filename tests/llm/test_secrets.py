import hashlib
import random
import re

import numpy as np

from rulelake.llm import secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SCHEMA = "doc_id long, text string, lang string, n_chars long"


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def texts():
    r = random.Random(5)
    bits = ["password", "PassWd", "tokeN", "ſecret", "secret", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "é", "漢", "\n",
            "AKIA", "AKIA" + "Z9" * 6, "AKIA" + "Q" * 11, "abcdef01" * 4, "abcdef01" * 3, "hunter2hunter2", "x.y=z/+-_", "short", "A", "f"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [*out, None, "", "a" * 50_000 + "é password=12345678", "0" * 31, "0" * 32, "token=AKIA" + "A" * 40]


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(i, t, None, 0) for i, t in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute(t)
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (t, told, r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("markov")) == told


def test_markov_separates_random_from_ordinary(spark):
    r = random.Random(9)
    words = ["customer", "ledger", "monthly", "report", "handler", "request", "island", "window", "session", "value"]
    docs = [(i, " ".join("_".join(r.choices(words, k=3)) + str(r.randint(1, 9)) for _ in range(200)), "en", 1) for i in range(40)]
    scanner = secrets.Scanner(secrets.train(spark.createDataFrame(docs, SCHEMA)))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choices(alphabet, k=32)) for _ in range(300)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    plain = ["_".join(r.choices(words, k=4)) + "7" for _ in range(300)]
    assert np.mean([bool(s) for s in scanner.spans(keys)]) > 0.95
    assert np.mean([bool(s) for s in scanner.spans(plain)]) < 0.02


def test_markov_scores_short_runs_and_runs_without_digits(spark):
    r = random.Random(9)
    words = ["customer", "ledger", "monthly", "report", "handler", "request", "island", "window", "session", "value"]
    docs = [(i, " ".join("_".join(r.choices(words, k=3)) + str(r.randint(1, 9)) for _ in range(200)), "en", 1) for i in range(40)]
    scanner = secrets.Scanner(secrets.train(spark.createDataFrame(docs, SCHEMA)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    # ten words are a poor model of the ordinary: short keys are told less surely than with a corpus
    for alphabet, n, least in ((letters, 32, 0.9), (letters, 16, 0.6), (letters + "0123456789", 16, 0.6), (letters + "0123456789", 19, 0.6)):
        keys = ["".join(r.choices(alphabet, k=n)) for _ in range(300)]
        assert np.mean([s == [(0, 3, n)] for s in scanner.spans(keys)]) > least
    plain = ["_".join(r.choices(words, k=k)) for k in (2, 3, 4) for _ in range(100)]
    assert np.mean([bool(s) for s in scanner.spans(plain)]) < 0.02


def test_masking_keeps_the_rest(spark):
    docs = [(1, "see é token = abcdefgh12 end", "en", 28), (2, None, None, None), (3, "clean", "fr", 5), (3, "clean", "fr", 5)]
    rows = secrets.masked(spark.createDataFrame(docs, SCHEMA)).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in rows] == [(1, "see é [SECRET] end", 18), (2, None, None), (3, "clean", 5), (3, "clean", 5)]
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_masking_leaves_other_kinds_of_n_chars_alone(spark):
    rows = secrets.masked(spark.createDataFrame([(1, "token = abcdefgh12 end", "x"), (2, "clean", None)], "doc_id long, text string, n_chars string"), np.zeros(secrets.N ** 2)).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("[SECRET] end", "x"), ("clean", None)]


def test_many_spans_in_a_long_text():
    some = " ".join(f"é token = abcdefgh{i:05d}" for i in range(20_000))
    spans = secrets.Scanner(np.zeros(secrets.N ** 2)).spans([None, some])
    assert spans[0] == [] and len(spans[1]) == 20_000
    assert all(some[a:b] == f"token = abcdefgh{i:05d}" for i, (a, _, b) in enumerate(spans[1]))


KEY = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"  # by code, as symbols are numbered


def brute_ratio(docs):
    """Log-likelihood ratio of symbol pairs, counted in plain Python."""
    from collections import Counter
    from math import log

    counts = Counter(), Counter()
    for text in docs:
        covered = [(a, b) for a, _, b in brute(text)]
        for m in re.finditer(r"[+/_=A-Za-z0-9-]{4,}", text or ""):
            inside = any(a < m.end() and m.start() < b for a, b in covered)
            counts[inside].update(zip(m[0], m[0][1:]))
    for key in secrets.random_strings().decode().split("\n"):
        for m in re.finditer(r"[+/_=A-Za-z0-9-]{4,}", key):
            counts[1].update(zip(m[0], m[0][1:]))
    totals = [{a: sum(c[a, b] + 0.5 for b in KEY) for a in KEY} for c in counts]
    return {(a, b): log((counts[1][a, b] + 0.5) / totals[1][a]) - log((counts[0][a, b] + 0.5) / totals[0][a]) for a in KEY for b in KEY}


def brute_markov(text, ratio):
    base, out = brute(text), []
    for m in re.finditer(r"[+/_=A-Za-z0-9-]{12,}", text or ""):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        score, n = sum(ratio[p] for p in zip(m[0], m[0][1:])), len(m[0]) - 1
        mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
        total, mean = (secrets.MIN_TOTAL, secrets.MIN_MEAN) if mixed else (secrets.PLAIN_TOTAL, secrets.PLAIN_MEAN)
        if abs(score - total) > 1e-6 and abs(score - mean * n) > 1e-6 and score >= total and score >= mean * n:
            out.append((m.start(), 3, m.end()))
    return out


def test_models_and_spans_against_plain_python(spark):
    r = random.Random(12)
    words = ["customer", "ledger", "monthly", "report", "handler", "request", "island", "window", "session", "value"]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
    rows = []
    for i in range(120):
        parts = ["_".join(r.choices(words, k=r.randint(1, 4))) + r.choice(["", "7", "é"]) for _ in range(40)]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randrange(40), r.choice(["漢", "token = ", "AKIA", ""]) + "".join(r.choices(alphabet, k=r.randint(8, 40))))
        rows.append((i, r.choice([" ", "\n", " 漢 "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "A" * 300), (203, "=" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratio = brute_ratio([t for _, t in rows])
    learned = secrets.train(docs)
    assert np.allclose(learned.reshape(secrets.N, secrets.N), [[ratio[a, b] for b in KEY] for a in KEY])
    got = {x.doc_id: x for x in secrets.scan(docs, learned).collect()}
    total = 0
    for i, text in rows:
        want = sorted(brute(text) + brute_markov(text, ratio))
        assert got[i].spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want) and got[i].n_markov == sum(k == 3 for _, k, _ in want)
        total += got[i].n_markov
    assert total > 20
