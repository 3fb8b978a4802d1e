"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of its frequent n-grams (four bytes of lower-cased text).  The filters share
their hash functions and are stored sliced: one slot holds the bits of all languages, so the AND of two slots
tells at once which languages contain an n-gram.  A text's votes per language are popcounts of these masks, less
the false positives that a filter of that fill gives, and the language with most votes wins.

Learned from labelled rows only (a bounded sample of them): text and lang.  Memory: the table of slots, at most
``1 / min_share`` n-grams a language.  Defined results: a null text or one without a letter is ``und`` with score
0; a text with letters of which no n-gram is known gets the language with most training rows and score 0 (so does
a tie in votes: then the first by name); without any labelled row every text is ``und``; repeated rows give
repeated results; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_frames, text_of
from .storage import BROADCAST_ROWS

#: Labelled rows to learn from at most (about), and the least share of a language's n-grams that one must have.
TRAIN_ROWS, MIN_SHARE = 20_000, 4e-6
#: Different texts that a language has at least in the sample, if it has so many.
LEAST_TEXTS = 100
#: Slots per n-gram of the largest language; two slots are read, so about 1.5 % of lookups are false positives.
ROOM = 16
LETTER = regex.compile(r"\p{L}")
#: Bytes of n-grams: lower-case letters stay, other ASCII is a blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams with at most one blank in a row, as uint32, and the texts' offsets in them."""
    buf, starts = K.buffer([f" {t} " if t else t for t in texts])
    b = FOLD[buf]
    n = len(b) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    w = b.astype(np.uint32)
    g = w[:n] | w[1:n + 1] << np.uint32(8) | w[2:n + 2] << np.uint32(16) | w[3:n + 3] << np.uint32(24)
    blank = b == 32
    pair = blank[:-1] & blank[1:]
    at = np.flatnonzero(~(pair[:n] | pair[1:n + 1] | pair[2:n + 2]))  # a text's edges are pairs: none crosses them
    return g[at], np.searchsorted(at, starts)


class Model:
    """languages, their false-positive rates, the sliced table and the commonest language."""

    def __init__(self, counts: pd.DataFrame, prior: dict[str, int]):
        """counts: lang, gram (the chosen n-grams of each)."""
        self.languages = sorted(prior)
        self.default = min(prior, key=lambda x: (-prior[x], x)) if prior else "und"
        most = int(counts.groupby("lang").size().max()) if len(counts) else 1
        self.bits = max(10, int(np.ceil(np.log2(ROOM * most))))
        self.table = np.zeros(((len(self.languages) + 63) // 64 or 1, 1 << self.bits), np.uint64)
        fill = []
        for n, lang in enumerate(self.languages):
            word, bit = divmod(n, 64)
            row = np.zeros(1 << self.bits, bool)
            for slot in self.slots(counts.loc[counts["lang"] == lang, "gram"].to_numpy(np.uint32)):
                row[slot] = True
            self.table[word] |= row.astype(np.uint64) << np.uint64(bit)
            fill.append(row.mean())
        self.false = np.array(fill) ** 2
        if len(self.languages) <= 8:  # the slots of few languages stay in the cache
            self.table = self.table.astype(np.uint8)

    def slots(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint32(32 - self.bits)
        with np.errstate(over="ignore"):
            return (g * np.uint32(2654435769)) >> shift, ((g ^ (g >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(374761393)) >> shift

    def votes(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Corrected votes by text and language, and the number of n-grams."""
        g, cut = grams(texts)
        a, b = self.slots(g)
        total = np.diff(cut)
        out = np.zeros((len(total), len(self.languages)))
        for word, slots in enumerate(self.table):
            mask = slots[a] & slots[b]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                run = np.zeros(len(mask) + 1, np.int64)
                np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), out=run[1:])
                out[:, 64 * word + bit] = np.diff(run[cut])
        return np.clip((out - total[:, None] * self.false) / (1 - self.false), 0, None), total

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score: the share of the text's n-grams that the language accounts for."""
        known = [t is not None and LETTER.search(t) is not None for t in texts]
        if not self.languages:
            return ["und"] * len(known), np.zeros(len(known))
        votes, total = self.votes(texts)
        best = votes.argmax(axis=1)
        most = votes[np.arange(len(best)), best]
        score = np.where(known, np.clip(most / np.maximum(total, 1), 0, 1), 0.0)
        lang = [("und" if not k else self.languages[i] if m > 0 else self.default) for k, i, m in zip(known, best, most)]
        return lang, score


def held_out(id_column: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of the id as text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE) -> Model:
    """From text and lang of (about) so many of the labelled rows, shared out evenly among the languages (those with
    fewer texts give all) and chosen by a hash of the text. Equal texts count twice at most, so they cannot crowd out
    others, and different ones are counted, so copies are not left out together; every language has LEAST_TEXTS, if it
    has so many."""
    usable = labelled.select("text", F.col("lang").cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()  # a row a language
    prior = {r.lang: r.n for r in found}
    each = max(LEAST_TEXTS, rows / max(1, len(prior)))
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, int(min(1.0, each / max(r.texts, 1)) * (1 << 30)))]) if prior else F.create_map().cast("map<string,int>")
    sample = usable.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")]).groupBy("lang", "text").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("k"))

    def count(batches):
        for pdf in batches:
            for (lang, k), some in pdf.groupby(["lang", "k"])["text"]:
                texts = some.tolist()
                for a, b in K.slices(texts):
                    g, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n * k})
    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg((F.sum("n") * F.lit(min_share)).alias("least"))
    totals = F.broadcast(totals) if len(prior) <= BROADCAST_ROWS else totals  # a row for each language, and these are counted
    chosen = counted.join(totals, "lang").where((F.col("n") >= F.col("least")) & (F.col("n") > 1))
    return Model(chosen.select("lang", "gram").toPandas(), prior)  # at most 1 / min_share rows a language


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in K.slices(texts):
                lang, score = model.predict(texts[a:b])
                part = pdf.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "lang_pred": lang, "score": score})
    return map_frames(documents.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, all columns as they are, whose text is in a known language with at least that score."""
    def run(batches):
        for batch in batches:
            texts, keep = text_of(batch), []
            for a, b in K.slices(texts):
                lang, score = model.predict(texts[a:b])
                keep += [x != "und" and s >= least for x, s in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return documents.mapInArrow(run, documents.schema)
