"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token, tokens per word and the entropy of its tokens
(byte-level BPE), and the share of tokens that fall back to single bytes (a piece vocabulary with byte fallback, word
by word).  Beside these stand plain counts: words, symbols, repeated lines and words in repeated three-word windows.

A text is rejected outside one of two kinds of band.  Fixed ones hold for its main script.  The others are taken from
all documents that pass the plain rules, by language label (without one: by script) and by length, since entropy grows
with it: the quartiles of each measure, widened by SPREAD times their distance.  Quartiles stay where they are while
fewer than a quarter of a group is junk on one side.  Lengths go by powers of two of the words; a length with fewer
than LEAST texts takes the band of the whole group, and a group with fewer has only the fixed band.

Defined results: null and empty texts have no words and are rejected; a text without letters has the script
``none``; repeated rows give repeated results; columns other than doc_id, text and lang are not read, and lang may be
absent; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .frames import map_frames
from .storage import Table, small

#: Scripts by ranges of code points; fixed values from the public Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
NAMES = ("none", *SCRIPTS)
#: Per script: least and most characters per token, most byte-fallback share, least entropy of the tokens in bits
#: (it grows with a text's length, so it is a bound for the shortest texts that pass the word count).
#: Each script lies between prose and random letters of its block as measured with the public vocabularies (prose of
#: several languages for greek, cyrillic, hebrew, arabic and indic, whose Malayalam has a fallback share of 0.64).
#: A script that given bands do not list has their bands of "other".
BANDS = {
    "latin": (1.2, 8.0, 0.12, 4.5),
    "none": (1.0, 8.0, 0.5, 3.0),
    "greek": (0.62, 4.0, 0.5, 3.5),
    "cyrillic": (0.7, 4.0, 0.35, 3.5),
    "hebrew": (0.62, 4.0, 0.12, 3.5),
    "arabic": (0.66, 4.0, 0.4, 3.5),
    "indic": (0.34, 4.0, 0.76, 2.8),
    "thai": (0.4, 4.0, 0.2, 3.0),
    "kana": (0.6, 4.0, 0.25, 4.0),
    "hangul": (0.36, 4.0, 0.45, 4.0),
    "han": (0.4, 4.0, 0.55, 4.5),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bands by group reach so many distances of the quartiles beyond these (a distance is at least NARROW of the middle);
#: fewer texts than LEAST make no band.
SPREAD, NARROW, LEAST = 2.0, 0.03, 30
#: Quartiles are exact to a hundredth; beyond MOST_BIN all values are alike.
BINS, MOST_BIN = 100, 100_000
GROUPED = ("chars_per_token", "tokens_per_word", "token_entropy")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


class Meter(tokens.Encoder):
    """An encoder that also knows, per word, its pieces and byte pieces in a second vocabulary."""

    def __init__(self, path: str, pieces: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        super().__init__(path)

    def clear(self) -> None:
        super().clear()
        self.n_pieces, self.n_bytes = tokens.Growing(np.int32), tokens.Growing(np.int32)

    def _learn(self, words: list[str]) -> None:
        super()._learn(words)
        got = self.pieces.encode([w.strip().encode("utf-8", "replace").decode() for w in words], num_threads=1)
        self.n_pieces.append(np.array([len(x) for x in got], np.int32))
        self.n_bytes.append(np.array([int(self.is_byte[x].sum()) if x else 0 for x in got], np.int32))


@functools.cache
def meter(path: str, pieces: str) -> Meter:
    return Meter(path, pieces)


@functools.cache
def script_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            out[a:b + 1] = n
    return out


def counts(texts) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    buf, starts = K.buffer(texts)
    first, last = K.words(buf, K.SPACE_WORD)
    cut = K.per_doc(first, starts)
    doc, n_words = K.doc_of(cut), np.diff(cut)
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    prefix = K.byte_prefix(buf)
    chars = np.bincount(doc, heads[last] - heads[first], len(n_words)).astype(np.int64)
    n_symbols = np.diff(K.per_doc(np.flatnonzero(SYMBOL[buf]), starts))

    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    full = np.searchsorted(first, ends) > np.searchsorted(first, begins)
    begins, ends = begins[full], ends[full]
    line_doc = np.searchsorted(starts, begins, side="right") - 1
    _, line_group = groups(line_doc, prefix.ranges(begins, ends))
    n_lines = np.bincount(line_doc, minlength=len(n_words))
    distinct = np.bincount(line_doc[group_heads(line_group)], minlength=len(n_words)) if len(line_doc) else 0
    hashes = prefix.ranges(first, last)
    at = np.arange(max(0, len(hashes) - 2))
    at = at[at + 3 <= cut[1:][doc[at]]] if len(at) else at
    size, group = groups(doc[at], K.Prefix(hashes).ranges(at, at + 3))
    again = at[size[group] > 1] if len(at) else at
    inside = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        inside[again + k] = True
    return {"n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": n_lines - distinct,
            "n_repeat_words": np.bincount(doc[inside[:len(doc)]], minlength=len(n_words))}


def groups(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the groups of equal (doc, key), and the group of each item."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return np.bincount(number), number


def group_heads(group: np.ndarray) -> np.ndarray:
    return np.unique(group, return_index=True)[1]


def measures(m: Meter, texts) -> dict[str, np.ndarray]:
    """Characters per token, byte-fallback share, token entropy and main script of each text."""
    n_docs = len(texts)
    pieces, fallback, cut, found = np.zeros(n_docs), np.zeros(n_docs), 0, []
    for w in m.parts(texts):
        doc = K.doc_of(w.offsets)
        pieces += np.bincount(doc, m.n_pieces.data[w.rows], n_docs)
        fallback += np.bincount(doc, m.n_bytes.data[w.rows], n_docs)
        some, at = m.part_ids(w)
        found.append(some)
        cut = cut + at
    ids = np.concatenate(found) if len(found) > 1 else found[0]
    n_tokens = np.diff(cut)
    keys = np.sort(K.doc_of(cut) << 32 | ids)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    c = np.diff(np.append(head, len(keys))).astype(float)
    safe = np.maximum(n_tokens, 1)
    entropy = np.log2(safe) - np.bincount(keys[head] >> 32, c * np.log2(c), n_docs) / safe
    cp, docs = tokens.code_points(texts)
    kinds = script_table()[cp]
    by = np.stack([np.diff(K.per_doc(np.flatnonzero(kinds == k), docs)) for k in range(1, len(NAMES))])
    script = np.where(by.max(axis=0) > 0, by.argmax(axis=0) + 1, 0)
    return {"n_tokens": n_tokens, "chars_per_token": np.diff(docs) / safe, "fallback_share": fallback / np.maximum(pieces, 1),
            "token_entropy": entropy,
            "script": np.array(NAMES, object)[script]}


def verdict(found: dict[str, np.ndarray], bands: dict) -> np.ndarray:
    """Whether each text lies in the bands of its script."""
    at = [bands[s] if s in bands else bands["other"] for s in found["script"]]
    low, high, most, least = np.array(at, float).reshape(-1, 4).T
    return ((found["chars_per_token"] >= low) & (found["chars_per_token"] <= high)
            & (found["fallback_share"] <= most) & (found["token_entropy"] >= least))


def bands_by_group(measured: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """Rows (group, length, measure, low, high) of the bands that all the rows given make, where length is null for a
    whole group. Rows are counted into bins first, so a group of any size is a bounded number of rows."""
    told = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.least(F.floor(F.col(m) * BINS), F.lit(MOST_BIN)).alias("bin")) for m in GROUPED])).alias("m")
    binned = measured.select("group", "length", told).groupBy("group", "length", "m.measure", "m.bin").count()
    binned = binned.unionByName(binned.withColumn("length", F.lit(None).cast("int")).groupBy("group", "length", "measure", "bin").agg(F.sum("count").alias("count")))
    upto = Window.partitionBy("group", "length", "measure").orderBy("bin")
    ranked = binned.withColumns({"upto": F.sum("count").over(upto), "n": F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("bin")))
    found = ranked.groupBy("group", "length", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("n").alias("n")).where(F.col("n") >= least)
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(NARROW / 2) * (F.col("q1") + F.col("q3"))) * F.lit(spread)
    return found.select("group", "length", "measure", ((F.col("q1") - wide) / BINS).alias("low"), ((F.col("q3") + 1 + wide) / BINS).alias("high"))


def rules(documents: DataFrame, path: str | None = None, pieces: str | None = None, bands: dict = BANDS,
          min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, spread: float = SPREAD) -> DataFrame:
    """Per document: the plain counts, base_failed, kept, and the measures."""
    path = path or tokens.vocabulary()
    pieces = pieces or tokens.vocabulary("piece_bpe_32k.model")

    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            for a, b in K.slices(texts):
                out = counts(texts[a:b])
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat * out["n_words"])
                found = measures(meter(path, pieces), texts[a:b])
                found["tokens_per_word"] = found["n_tokens"] / np.maximum(out["n_words"], 1)
                label = pdf["lang"].iloc[a:b].to_numpy(object)
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].to_numpy(), **out, "base_failed": failed,
                                    "inside": ~failed & verdict(found, bands), **found,
                                    "group": [f"script {s}" if x is None else f"lang {x}" for x, s in zip(label, found["script"])],
                                    "length": np.frexp(np.maximum(out["n_words"], 1))[1]})
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    measured = Table(map_frames(
        documents.select("doc_id", "text", lang.alias("lang")), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
             "inside boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, "
             "tokens_per_word double, group string, length int"))
    pivot = bands_by_group(measured.df.where("NOT base_failed"), spread).groupBy("group", "length").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("band"))  # three measures
    pivot = Table(pivot).df
    by_length = pivot.where("length IS NOT NULL").withColumnRenamed("band", "own")
    whole = pivot.where("length IS NULL").drop("length").withColumnRenamed("band", "all")
    rows = measured.df.join(small(by_length), ["group", "length"], "left").join(small(whole), "group", "left")
    band = F.coalesce("own", "all")
    within = F.lit(True)
    for m in GROUPED:
        within = within & F.coalesce(F.col(m).between(band[m]["low"], band[m]["high"]), F.lit(True))
    return rows.withColumn("kept", F.col("inside") & within).drop("inside", "own", "all", "group", "length")
