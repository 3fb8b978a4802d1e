"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of a fixed number of words.  Every passage of every whole text is encoded: shares of
character classes, a fixed random projection of pairs of classes, and what it repeats (words in a row, runs of three
words and lines that the document had before).  Only documents have labels.  A small network learns from them how to
weigh passages: each encoded passage h gets the weight softmax(w . (tanh(V h) * sigmoid(U h))) among its document's
passages, and the weighted sum of the passages is scored.  So one bad passage of many can decide, or be outvoted.

The network is fitted on the driver on a bounded sample: ``TRAIN_DOCUMENTS`` labelled documents, half of each label
where there are so many, chosen by a hash of the id, those with at most ``TRAIN_PASSAGES`` passages; weights restore the
labels' true shares, which are counted over all labelled rows.  Scoring is one scan.

Defined results: null and empty texts and texts without words are one passage of no words; a null doc_id is not held out
and is scored like any other; an id with both labels, or a label other than 0 and 1, teaches nothing; of several rows of
one labelled id the one with the least text teaches; without labels every score is 0.5; repeated rows give repeated
results; other columns of either table are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import arrow_schema, record
from .language import held_out

#: Words of a passage; labelled documents to learn from, and the passages that one of them may have.
PASSAGE, TRAIN_DOCUMENTS, TRAIN_PASSAGES = 128, 4000, 32
#: Character classes: other, blank, newline, small, capital, digit, beyond ASCII, and each ASCII mark.
CLASSES = np.zeros(256, np.int64)
CLASSES[[9, 32]], CLASSES[10], CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 4, 5, 6
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASSES[_MARKS] = np.arange(7, 7 + len(_MARKS))
N_CLASSES = 7 + len(_MARKS)
#: Numbers that stand for the pairs of classes, and the projection onto them.
PAIRS = 32
_PROJECTION = np.random.default_rng(7).normal(0, 1, ((N_CLASSES + 1) ** 2, PAIRS)).astype(np.float32)
_PROJECTION[N_CLASSES * (N_CLASSES + 1):] = 0  # what follows a text's end is another text
N_FEATURES = N_CLASSES + PAIRS + 6


def _seen(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the key stood in the same document before."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    out = np.zeros(len(key), bool)
    out[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    return out


def encode(texts, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the texts' offsets in them (every text has one at least)."""
    buf, starts = K.buffer(texts)
    n_docs = len(starts) - 1
    first, last = K.words(buf, K.SPACE_WORD)
    cut = K.per_doc(first, starts)
    doc = K.doc_of(cut)
    n_words = np.diff(cut)
    bags = np.append(0, np.cumsum(np.maximum(1, -(-n_words // size))))
    n = int(bags[-1])
    inside = np.arange(len(first)) - cut[:-1][doc]  # the word's number in its text
    passage = bags[:-1][doc] + inside // size
    begin = np.zeros(n + 1, np.int64)
    begin[bags[:-1]], begin[n] = starts[:-1], len(buf)
    later = (inside % size == 0) & (inside > 0)
    begin[passage[later]] = first[later]
    length = np.maximum(np.diff(begin), 1).astype(np.float32)
    owner = np.repeat(np.arange(n), np.diff(begin))
    classes = CLASSES[buf]
    classes[starts[1:] - 1] = N_CLASSES  # the newline that K.buffer puts between texts
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(np.bincount(owner * (N_CLASSES + 1) + classes, minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES] / length[:, None])
    kinds = (N_CLASSES + 1) ** 2
    pair = np.bincount(owner[:-1] * kinds + classes[:-1] * (N_CLASSES + 1) + classes[1:], minlength=n * kinds).reshape(n, kinds) if len(buf) else np.zeros((n, kinds))
    out[:, N_CLASSES:N_CLASSES + PAIRS] = np.sqrt(pair.astype(np.float32) / length[:, None]) @ _PROJECTION
    prefix = K.byte_prefix(buf)
    words = prefix.ranges(first, last)
    told = np.bincount(passage, minlength=n).astype(np.float32)
    share = lambda flags, of: np.bincount(of[flags], minlength=n) / np.maximum(told, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(np.arange(len(words)) + 3 <= cut[1:][doc])
    runs = K.Prefix(words).ranges(at, at + 3)
    again = at[_seen(doc[at], runs)]
    lines = np.append(0, np.flatnonzero(buf == 10) + 1)[:-1] if len(buf) else np.zeros(0, np.int64)
    ends = np.append(lines[1:], len(buf)) - 1
    full = np.searchsorted(first, ends) > np.searchsorted(first, lines)
    lines, ends = lines[full], ends[full]
    twice = _seen(np.searchsorted(starts, lines, side="right") - 1, prefix.ranges(lines, ends))
    repeated = np.bincount(owner[lines[twice]], (ends - lines)[twice], minlength=n) if twice.any() else np.zeros(n)
    out[:, -6] = share(same, passage)
    out[:, -5] = np.bincount(passage[again], minlength=n) / np.maximum(told, 1)
    out[:, -4] = np.minimum(repeated / length, 1)
    out[:, -3] = np.log1p(told)
    out[:, -2] = np.log1p(np.bincount(passage, last - first, minlength=n) / np.maximum(told, 1))
    out[:, -1] = np.log1p(np.repeat(n_words, np.diff(bags)))
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Encoder (tanh), gated attention and a logistic score over the weighted sum."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, shape[-1] ** -0.5, shape)
        self.mean, self.scale = mean, scale
        self.p = {"E": draw(hidden, len(mean)), "e": np.zeros(hidden), "V": draw(gate, hidden), "U": draw(gate, hidden), "w": np.zeros(gate), "c": np.zeros(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages; bags: offsets of documents, none of them empty."""
        p, head = self.p, bags[:-1]
        h = np.tanh(x @ p["E"].T + p["e"])
        v, u = np.tanh(h @ p["V"].T), _sigmoid(h @ p["U"].T)
        logit = (v * u) @ p["w"]
        n = np.diff(bags)
        raised = np.exp(logit - np.repeat(np.maximum.reduceat(logit, head), n))
        a = raised / np.repeat(np.add.reduceat(raised, head), n)
        z = np.add.reduceat(a[:, None] * h, head, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"][0])}

    def gradient(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted log-loss."""
        p, f, n = self.p, self.forward(x, bags), np.diff(bags)
        d = weight * (f["score"] - label) / weight.sum()
        by = np.repeat(d, n)[:, None] * p["c"]  # of the weighted sum, at each passage
        pull = (by * f["h"]).sum(axis=1)
        d_logit = f["a"] * (pull - np.repeat(np.add.reduceat(f["a"] * pull, bags[:-1]), n))
        d_vu = d_logit[:, None] * p["w"]
        d_v, d_u = d_vu * f["u"] * (1 - f["v"] ** 2), d_vu * f["v"] * f["u"] * (1 - f["u"])
        d_h = (f["a"][:, None] * by + d_v @ p["V"] + d_u @ p["U"]) * (1 - f["h"] ** 2)
        return {"E": d_h.T @ x, "e": d_h.sum(axis=0), "V": d_v.T @ f["h"], "U": d_u.T @ f["h"], "w": (f["v"] * f["u"]).T @ d_logit, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 250, step: float = 0.02, decay: float = 1e-4) -> Network:
        """Adam over the whole sample."""
        x = (x - self.mean) / self.scale
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, rounds + 1):
            for k, g in self.gradient(x, bags, label, weight).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, and the attention of their passages with the texts' offsets in them."""
        x, bags = encode(texts, size)
        f = self.forward((x - self.mean) / self.scale, bags)
        return f["score"], f["a"], bags


def train(documents: DataFrame, labels: DataFrame, size: int = PASSAGE, sample: int = TRAIN_DOCUMENTS, passages: int = TRAIN_PASSAGES) -> Network | None:
    """A network fitted to quality labels that are not held out; None without any."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").select("id", F.col("label").cast("int").alias("label"))
    shares = {r.label: r["count"] for r in told.groupBy("label").count().collect()}  # two labels
    if not shares:
        return None
    chosen = [told.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for k in (0, 1)]
    some = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most ``sample`` rows
    bags = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(some, "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in K.slices(texts):
                x, cut = encode(texts[a:b], size)
                keep = [(i, x[p:q].astype("<f4").tobytes()) for i, (p, q) in enumerate(zip(cut[:-1], cut[1:]), a) if q - p <= passages]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in keep], pa.int64())), batch.column(1).take(pa.array([i for i, _ in keep], pa.int64())), pa.array([v for _, v in keep], pa.binary())], ["id", "label", "x"])
    rows = sorted(bags.mapInArrow(run, "id long, label int, x binary").collect())
    if not rows:
        return None
    label = np.array([r.label for r in rows], float)
    own = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in rows]
    x, cut = np.concatenate(own).astype(float), np.append(0, np.cumsum([len(v) for v in own]))
    weight = np.array([shares[r.label] for r in rows]) / np.bincount(label.astype(int), minlength=2)[label.astype(int)]
    return Network(x.mean(axis=0), x.std(axis=0) + 1e-3).fit(x, cut, label, weight)


def scores(documents: DataFrame, model: Network | None, size: int = PASSAGE, with_attention: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_passages and the passage with the most attention (and all
    attention weights)."""
    ddl = "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long" + (", attention array<double>" if with_attention else "")
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(2).to_pylist()
            for a, b in K.slices(texts):
                if model is None:
                    score, attention, bags = np.full(b - a, 0.5), np.ones(b - a), np.arange(b - a + 1)
                else:
                    score, attention, bags = model.score(texts[a:b], size)
                n = np.diff(bags)
                peak = np.lexsort((-np.arange(len(attention)), attention, np.repeat(np.arange(b - a), n)))[bags[1:] - 1] - bags[:-1]
                out = {"doc_id": batch.column(0).slice(a, b - a), "held_out": batch.column(1).slice(a, b - a), "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_passages": n, "top_passage": peak}
                yield record(schema, out | ({"attention": [attention[p:q] for p, q in zip(bags[:-1], bags[1:])]} if with_attention else {}))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, ddl)
