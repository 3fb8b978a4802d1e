"""Benchmark decontamination by winnowing.

Every text is cut into words; of each sliding window of ``span - k + 1`` consecutive k-gram hashes the smallest
(the rightmost of equals) is kept.  Equal spans of ``span`` words keep the same k-gram, so joining the kept
fingerprints of documents and benchmark items finds every shared span of that length.  A fingerprint carries the hashes
of the spans around it; a hit is extended where two of these, equally far from it, are equal.  Items shorter than
``span`` have no full window: their whole word sequence is a fingerprint of its own, looked up at every position.

The benchmark's fingerprints are written once; of them only a bitmap of bounded size goes to the tasks that read the
documents, which keep the fingerprints that it lets through.  Those are joined with the benchmark's: by broadcast if these
are counted small, else over salted copies, so that a fingerprint which many documents share is spread.  Documents are
scanned in place and their texts are never shuffled; neither table is collected.

Defined results: null and empty texts have no words and no hits; items without words or without an id hit
nothing; repeated items (equal ids) count once; other columns of either table are not read; a null doc_id is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_frames
from .storage import Table, small, spread_join

#: Slots of the bitmap that sorts documents' fingerprints: so many for each fingerprint of the benchmark, within bounds.
ROOM, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Slots that one row carries to the driver.
PAGE = 1 << 16
FINGERPRINT = "hash long, size int, spans array<long>"


def winnow(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions kept by at least one window [i, i + width); valid[i] tells which windows exist."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = hashes[:n].copy()
    for s in range(1, width):
        np.minimum(low, hashes[s:s + n], out=low)
    at = np.zeros(n, np.int64)
    for s in range(width):
        at[hashes[s:s + n] == low] = s
    return np.unique((np.arange(n) + at)[valid[:n]])


class Text:
    """The words of a batch: hashes, and for each word the end of its document."""

    def __init__(self, texts):
        buf, starts = K.buffer(texts)
        first, last = K.words(buf, K.PLAIN_WORD)
        self.hashes = K.byte_prefix(K.LOWER[buf]).ranges(first, last)
        self.cut = K.per_doc(first, starts)
        self.doc = K.doc_of(self.cut)
        self.begin, self.end = self.cut[:-1][self.doc], self.cut[1:][self.doc]
        self.prefix = K.Prefix(self.hashes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n words from each position, and whether these lie in one document."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return self.prefix.ranges(at, at + n), at + n <= self.end[: len(at)]


def fingerprints(d: Text, span: int, k: int, sizes=(), keep=None) -> dict[str, np.ndarray]:
    """Kept k-grams (size 0) and, for other sizes, all runs of so many words: word position, hash, size, and the hashes of
    the spans that begin up to span - k words before it (0 where there is none). keep turns away by hash and size."""
    grams, _ = d.grams(k)
    windows, fits = d.grams(span)
    kept = winnow(grams, fits, span - k + 1)
    some = keep(grams[kept], 0) if keep else np.ones(len(kept), bool)
    kept = kept[some]
    around = np.zeros((len(kept), span - k + 1), np.uint64)
    for s in range(span - k + 1):
        at = kept - s
        there = (at >= d.begin[kept]) & (at < len(fits))
        there &= fits[np.where(there, at, 0)] if len(fits) else False
        around[there, s] = windows[at[there]] | np.uint64(1)  # a hash of 63 bits that is not 0
    out = [(kept, grams[kept], np.zeros(len(kept), np.int32), around)]
    for m in sizes:
        runs, whole = d.grams(m)
        at = np.flatnonzero(whole)
        if keep:
            at = at[keep(runs[at], m)]
        out.append((at, runs[at], np.full(len(at), m, np.int32), np.zeros((len(at), span - k + 1), np.uint64)))
    return dict(zip(("at", "hash", "size", "spans"), (np.concatenate(x) for x in zip(*out))))


def _slots(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    return (K.mix(hashes + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)


def items_of(benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """item, hash, size and spans: the benchmark's fingerprints; a short item has one, of its own size."""
    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["item"].to_numpy(object)
            for a, b in K.slices(texts):
                d = Text(texts[a:b])
                f = fingerprints(d, span, k)
                words = np.diff(d.cut)
                short = np.flatnonzero((words > 0) & (words < span))
                whole = d.prefix.ranges(d.cut[short], d.cut[short] + words[short])
                doc = np.append(d.doc[f["at"]], short)
                yield {"item": ids[a:b][doc], "hash": np.append(f["hash"], whole).view(np.int64), "size": np.append(f["size"], words[short]).astype(np.int32),
                       "spans": [*f["spans"].view(np.int64), *np.zeros((len(short), span - k + 1), np.int64)]}
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    return map_frames(known, run, f"item string, {FINGERPRINT}").distinct()


def bitmap(items: DataFrame, n: int) -> np.ndarray:
    """Which slots the fingerprints take: 2**MOST_BITS at most, in pages that tasks fill and that are united by page."""
    bits = int(np.clip(np.ceil(np.log2(max(1, ROOM * n))), LEAST_BITS, MOST_BITS))

    def fill(batches):
        whole = np.zeros(1 << bits, bool)
        for pdf in batches:
            for size, rows in pdf.groupby("size")["hash"]:
                whole[_slots(rows.to_numpy(np.int64).view(np.uint64), int(size), bits)] = True
        pages = whole.reshape(-1, min(PAGE, len(whole)))
        full = np.flatnonzero(pages.any(axis=1))
        yield {"page": full.astype(np.int32), "bits": [np.packbits(pages[p]).tobytes() for p in full]}

    def unite(pdf):
        out = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
        for more in pdf["bits"].iloc[1:]:
            out |= np.frombuffer(more, np.uint8)
        return pd.DataFrame({"page": pdf["page"].iloc[:1], "bits": [out.tobytes()]})
    out = np.zeros(1 << bits, bool)
    pages = map_frames(items.select("hash", "size"), fill, "page int, bits binary").groupBy("page").applyInPandas(unite, "page int, bits binary")
    for r in pages.collect():  # 2**MOST_BITS bits at most
        own = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
        out[r.page * len(own):(r.page + 1) * len(own)] = own
    return out


def _scan(documents: DataFrame, taken: np.ndarray, sizes: list[int], span: int, k: int, ids: tuple[str, ...]):
    """row (a number of its own), the id columns, n_words, and the fingerprints that the bitmap lets through, packed; and
    what makes rows of them again."""
    bits = int(np.log2(len(taken)))
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(taken))
    width = span - k + 1

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        table = np.unpackbits(shared.value).astype(bool)
        keep = lambda hashes, size: table[_slots(hashes, size, bits)]
        for pdf in batches:
            texts, names = pdf["text"].tolist(), {c: pdf[c].to_numpy() for c in ids}
            for a, b in K.slices(texts):
                d = Text(texts[a:b])
                f = fingerprints(d, span, k, sizes, keep)
                doc = d.doc[f["at"]] if len(f["at"]) else np.zeros(0, np.int64)
                order = np.argsort(doc, kind="stable")
                packed = np.concatenate([(f["at"] - d.cut[doc])[order, None].astype("<i8"), f["size"][order, None].astype("<i8"), f["hash"][order, None].view("<i8"), f["spans"][order].view("<i8")], axis=1)
                cut = np.searchsorted(doc[order], np.arange(b - a + 1))
                yield {"row": row + np.arange(b - a), **{c: x[a:b] for c, x in names.items()}, "n_words": np.diff(d.cut), "found": [packed[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]}
                row += b - a

    def unpack(batches):
        for pdf in batches:
            parts = [np.frombuffer(x, "<i8").reshape(-1, 3 + width) for x in pdf["found"]]
            rows = np.repeat(pdf["row"].to_numpy(np.int64), [len(x) for x in parts])
            whole = np.concatenate([np.zeros((0, 3 + width), np.int64), *parts])
            yield {"row": rows, "at": whole[:, 0], "size": whole[:, 1].astype(np.int32), "hash": whole[:, 2], "own": list(whole[:, 3:])}
    rows = map_frames(documents.select(*ids, "text"), run, f"row long, {', '.join(f'{c} long' for c in ids)}, n_words long, found binary")
    return rows, lambda df: map_frames(df.where(F.length("found") > 0).select("row", "found"), unpack, "row long, at long, size int, hash long, own array<long>")


def hits(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6, ids: tuple[str, ...] = ("doc_id",)) -> tuple[Table, Table]:
    """A row for each document (row, its ids, n_words), and its shared spans (row, begin, end, item)."""
    items = Table(items_of(benchmark, span, k))
    n = items.df.count()
    sizes = sorted(r[0] for r in items.df.where("size > 0").select("size").distinct().collect())  # less than span
    rows, unpacked = _scan(documents, bitmap(items.df, n), sizes, span, k, ids)
    rows = Table(rows)
    key = ["hash", "size"]
    met = spread_join(unpacked(rows.df), items.df, key, "inner")
    zero, step = F.lit(0).cast("long"), F.sequence(F.lit(0), F.lit(span - k))
    equal = F.filter(step, lambda s: (F.get("own", s) == F.get("spans", s)) & (F.get("own", s) != zero))
    begins = F.when(F.col("size") > 0, F.array(F.col("at"))).otherwise(F.transform(equal, lambda s: F.col("at") - s))
    length = F.when(F.col("size") > 0, F.col("size")).otherwise(span)
    found = Table(met.select("row", F.explode(begins).alias("begin"), length.alias("length"), "item").select("row", "begin", (F.col("begin") + F.col("length")).alias("end"), "item").distinct())
    items.drop()
    return rows, found


def spans(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6) -> DataFrame:
    """Per document row: doc_id, n_words, hit word ranges (sorted) and the item ids that occur."""
    rows, found = hits(documents, benchmark, span, k)
    ranges = F.array_sort(F.collect_set(F.struct("begin", "end")))
    by_row = found.df.groupBy("row").agg(ranges.alias("ranges"), F.array_sort(F.collect_set("item")).alias("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    joined = rows.df.select("row", "doc_id", "n_words").join(small(by_row), "row", "left")
    return joined.select("doc_id", "n_words", none("ranges", "array<struct<begin:bigint,end:bigint>>"), none("items", "array<string>"))


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6) -> DataFrame:
    """Per document: n_words, n_hit (words inside a shared span), n_items, items_sha256, contaminated."""
    step = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["begin"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["end"]).alias("upto")), lambda s: s["n"])
    return spans(documents, benchmark, span, k).select("doc_id", "n_words", step.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                                                       (F.size("items") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6) -> DataFrame:
    """The documents, all columns as they are, that share no such span with any item. Texts are named by 128 bits."""
    at = {c: f"c{i}" for i, c in enumerate(documents.columns)}  # columns by number, so that no name clashes
    name = {"h1": lambda text: F.xxhash64(text), "h2": lambda text: F.xxhash64(text, F.lit(7))}
    rows, found = hits(documents.select(*[f(F.col("text")).alias(h) for h, f in name.items()], "text"), benchmark, span, k, tuple(name))
    gone = Table(rows.df.join(found.df.select("row").distinct(), "row", "left_semi").select(*name).distinct())
    for done in (rows, found):
        done.drop()
    numbered = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in at.items()])
    kept = spread_join(numbered.withColumns({h: f(F.col(at["text"])) for h, f in name.items()}), gone.df, list(name), "left_anti")
    return kept.select(*[F.col(x).alias(c) for c, x in at.items()])
