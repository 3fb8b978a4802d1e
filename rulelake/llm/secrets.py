"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Fixed patterns give the spans of kinds ``assign``, ``access`` and ``hex`` (leftmost, non-overlapping per kind).
The kind ``markov`` adds runs of key characters that overlap none of these and whose log-likelihood ratio under two
first-order character models says random rather than ordinary, more clearly so for runs without a digit or a letter.  The models are
counted from labelled samples: ordinary are the runs of a bounded sample of documents that no fixed pattern
covers, random are those the patterns cover plus seeded random strings in the usual key alphabets.

Offsets are code points, ends exclusive.  Defined results: null and empty texts have no spans; repeated rows give
repeated results; only doc_id and text are read; an empty table trains on the random strings alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_frames, text_of

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

HEX = np.zeros(256, bool)
HEX[48:58] = HEX[97:103] = True
KEY = np.zeros(256, bool)
KEY[48:58] = KEY[65:91] = KEY[97:123] = True
KEY[[43, 47, 95, 61, 45]] = True
DIGIT = np.zeros(256, np.int64)
DIGIT[48:58] = 1
LETTER = np.zeros(256, np.int64)
LETTER[65:91] = LETTER[97:123] = 1

#: A markov span has at least so many characters, and so large a log-likelihood ratio in all and per character.
MIN_RUN, MIN_TOTAL, MIN_MEAN = 12, 12.0, 0.5
#: The same for runs that lack digits or letters.
PLAIN_TOTAL, PLAIN_MEAN = 16.0, 0.75
#: The models are counted from about so many documents, chosen by a hash of their id.
TRAIN_DOCUMENTS = 2000
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[KEY] = np.arange(KEY.sum())
N = int(KEY.sum())


def runs(buf: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = K.words(buf, allowed)
    keep = b - a >= least
    return a[keep], b[keep]


def base_spans(parts: list[bytes], buf: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) in bytes from the document's start."""
    found = []
    for i, part in enumerate(parts):
        low = part.lower()
        if any(h in low for h in ASSIGN_HINTS):
            found += [(i, 0, m.start(), m.end()) for m in ASSIGN.finditer(part) if m.end(1) - m.start(1) >= MIN_ASSIGN]
        if b"AKIA" in part:
            found += [(i, 1, m.start(), m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= MIN_ACCESS]
    a, b = runs(buf, HEX, MIN_HEX)
    doc = np.searchsorted(starts, a, side="right") - 1
    return found + list(zip(doc.tolist(), [2] * len(a), (a - starts[doc]).tolist(), (b - starts[doc]).tolist()))


def _bytes(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf, starts = K.buffer(texts)
    return parts, buf, starts


def _free(a: np.ndarray, b: np.ndarray, taken: list[tuple[int, int]]) -> np.ndarray:
    """Which ranges overlap none of those taken (both in buffer offsets)."""
    if not taken or not len(a):
        return np.ones(len(a), bool)
    t = np.array(sorted(taken))
    upto = np.maximum.accumulate(t[:, 1])
    i = np.searchsorted(t[:, 0], b)  # those that start before the range's end
    return (i == 0) | (upto[np.maximum(i - 1, 0)] <= a)


def transitions(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of symbol pairs inside the ranges."""
    n = b - a - 1
    at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
    return np.bincount(_SYMBOLS[buf[at]] * N + _SYMBOLS[buf[at + 1]], minlength=N * N)


def random_strings(count: int = 4000, seed: int = 11) -> bytes:
    """Labelled random samples: seeded keys in the usual alphabets, one to a line."""
    r = np.random.default_rng(seed)
    alphabets = [b"0123456789abcdef", b"0123456789ABCDEF", b"abcdefghijklmnopqrstuvwxyz0123456789",
                 b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
                 b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    return b"\n".join(bytes(r.choice(np.frombuffer(alphabets[i % len(alphabets)], np.uint8), 32)) for i in range(count))


def train(documents: DataFrame, sample: int = TRAIN_DOCUMENTS) -> np.ndarray:
    """Log-likelihood ratio (random minus ordinary) of each symbol pair."""
    texts = documents.select("text").where(F.col("text").isNotNull())
    share = min(1.0, sample / max(1, texts.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()  # equal texts count once

    def count(batches):
        total = np.zeros((2, N * N), np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for x, y in K.slices(texts):
                parts, buf, starts = _bytes(texts[x:y])
                taken = [(starts[i] + a, starts[i] + b) for i, _, a, b in base_spans(parts, buf, starts)]
                a, b = runs(buf, KEY, 4)
                free = _free(a, b, taken)
                total[0] += transitions(buf, a[free], b[free])
                total[1] += transitions(buf, a[~free], b[~free])
        label, pair = np.nonzero(total)
        yield pd.DataFrame({"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": total[label, pair]})

    counts = np.zeros((2, N * N))
    seeded = np.frombuffer(random_strings(), np.uint8)
    counts[1] += transitions(seeded, *runs(seeded, KEY, 4))
    rows = chosen.mapInPandas(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most two models of N * N pairs
        counts[r.label, r.pair] += r.n
    smooth = counts.reshape(2, N, N) + 0.5
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel()


class Scanner:
    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    def spans(self, texts) -> list[list[tuple[int, int, int]]]:
        """Per text, (start, kind, end) in code points, sorted."""
        parts, buf, starts = _bytes(texts)
        found = base_spans(parts, buf, starts)
        a, b = runs(buf, KEY, MIN_RUN)
        free = _free(a, b, [(starts[i] + x, starts[i] + y) for i, _, x, y in found])
        a, b = a[free], b[free]
        if len(a):
            digits, letters = np.cumsum(DIGIT[buf]), np.cumsum(LETTER[buf])
            mixed = (digits[b - 1] - digits[a] + DIGIT[buf[a]] > 0) & (letters[b - 1] - letters[a] + LETTER[buf[a]] > 0)
            n = b - a - 1
            at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
            score = np.add.reduceat(self.ratio[_SYMBOLS[buf[at]] * N + _SYMBOLS[buf[at + 1]]], np.cumsum(n) - n)
            told = (score >= np.where(mixed, MIN_TOTAL, PLAIN_TOTAL)) & (score >= np.where(mixed, MIN_MEAN, PLAIN_MEAN) * n)
            for x, y in zip(a[told].tolist(), b[told].tolist()):
                i = int(np.searchsorted(starts, x, side="right")) - 1
                found.append((i, 3, x - int(starts[i]), y - int(starts[i])))
        out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
        if found:
            points = np.zeros(len(buf) + 1, np.int64)  # code points before each byte
            np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
            for i, kind, x, y in found:
                head = int(points[starts[i] + x] - points[starts[i]])
                out[i].append((head, kind, head + y - x))  # spans are ASCII
        return [sorted(x) for x in out]


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(documents: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """Per document: counts of the fixed kinds and of markov, all spans, and a digest of the fixed ones."""
    scanner = Scanner(train(documents) if model is None else model)

    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            for a, b in K.slices(texts):
                found = scanner.spans(texts[a:b])
                n = np.array([[sum(k == kind for _, k, _ in s) for kind in range(4)] for s in found], np.int64)
                base = [_told([x for x in s if x[1] < 3]) for s in found]
                yield pd.DataFrame({
                    "doc_id": ids.iloc[a:b].to_numpy(), "n_assign": n[:, 0], "n_access": n[:, 1], "n_hex": n[:, 2],
                    "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base],
                    "spans": [_told(s) for s in found], "n_markov": n[:, 3]})
    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def mask(text: str, spans: list[tuple[int, int, int]], filler: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced."""
    out, upto = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[upto:a], filler]
        upto = b
    return "".join(out) + text[upto:]


def masked(documents: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """The documents with secrets masked in text, and n_chars (if it is a long) following the new text; other columns
    stay."""
    scanner = Scanner(train(documents) if model is None else model)
    counted = dict(documents.dtypes).get("n_chars") == "bigint"

    def run(batches):
        for batch in batches:
            texts = text_of(batch)
            new, counts = list(texts), batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if counted else []
            for a, b in K.slices(texts):
                for i, s in enumerate(scanner.spans(texts[a:b]), a):
                    if s:
                        new[i] = mask(texts[i], s)
                        if counts:
                            counts[i] = len(new[i])
            for name, values in (("text", new), ("n_chars", counts)):
                if values:
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch
    return documents.mapInArrow(run, documents.schema)
