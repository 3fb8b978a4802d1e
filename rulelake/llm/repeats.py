"""Removal of long repeated byte strings, by sampled suffixes that are sorted in shards and merged by refinement.

A position's window is the ``span`` bytes from it.  Each window is filed under the smallest hashed k-gram in it (its
anchor), so equal windows have equal anchors at equal distances; consecutive windows with one anchor form a run.

1. Shards (tasks) sort their runs by anchor and content and keep the first of equal runs.  All later ones are
   repeats as a whole.
2. Runs of all shards meet by anchor; again only the first of equal runs stays.  Anchors with one run left are done.
3. For the others the bytes of the runs are fetched and their windows merged by iterative interleave refinement: the
   windows start in one interval per anchor and distance, and each round splits the intervals by the next eight
   bytes.  An interval of one window is dropped at once; the round that splits two windows bounds their common
   prefix; what is still together after ``span`` bytes is a repeated interval, of which the first window stays.
   Where very many runs share an anchor, windows are dealt out by a hash of their bytes instead.

Only anchors (about one in 43 bytes) are shuffled, texts once at most per step, and nothing is collected.

Defined results: null counts as empty; a text shorter than ``span`` loses nothing; rows with the same doc_id count
as one document whose later rows (by text) are treated as if they stood after the earlier ones only if their ids
differ: equal windows at equal (doc_id, start) do not remove each other; a null doc_id takes part in nothing and
keeps its text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_frames
from .blobs import by_part, deal, gather, schema
from .storage import Table, partitions, small

SPAN, GRAM = 100, 16
#: Bits of a hash that give way to its place.
PLACE_BITS = 24
#: Runs that a shard sorts at once; runs of one anchor beyond which windows are dealt out by content.
FLUSH, HOT = 2_000_000, 50_000
#: Windows whose intervals are refined at once (whole anchors).
SLAB = 500_000

CUTS = {"doc": "<i8", "begin": "<i8", "end": "<i8"}
RUNS = {"anchor": "<u8", "content": "<u8", "of": "<i8", "at": "<i8", "n": "<i4"}
WANTED = {"of": "<i8", "at": "<i8", "n": "<i4", "anchor": "<u8", "hot": "<i1"}
BYTES = {"anchor": "<u8", "distance": "<i4", "of": "<i8", "at": "<i8", "n": "<i4", "bytes": "<u1", "key": "<u8", "key_of": "<i8", "key_at": "<i8"}


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of that width, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def least_places(hashes: np.ndarray, width: int, bits: int = PLACE_BITS) -> np.ndarray:
    """Where the least hash of each window of that width lies, by all bits but the last (the first of equals). Places
    are counted within stretches of 2**bits, so a window's result depends on its own hashes alone."""
    low, out = np.uint64((1 << bits) - 1), []
    for a in range(0, max(1, len(hashes) - width + 1), (1 << bits) - width + 1):
        some = hashes[a:a + (1 << bits)]
        out.append((sliding_least((some & ~low) | np.arange(len(some), dtype=np.uint64), width) & low).astype(np.int64) + a)
    return np.concatenate(out)


class Runs:
    """Runs of windows of a batch: document number, first window, number of windows, anchor, content hash."""

    def __init__(self, texts, span: int, gram: int):
        self.buf, self.starts = K.buffer(texts)
        n = len(self.buf)
        sizes = np.diff(self.starts) - 1
        if n < span:
            self.doc = self.first = self.count = self.where = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        prefix = K.byte_prefix(self.buf)
        at = np.arange(n - gram + 1)
        hashes = prefix.ranges(at, at + gram)
        where = least_places(hashes, span - gram + 1)
        inside = np.zeros(n + 1, np.int8)  # windows that lie in one document
        np.add.at(inside, self.starts[:-1][sizes >= span], 1)
        np.add.at(inside, (self.starts[:-1] + sizes - span + 1)[sizes >= span], -1)
        inside = np.cumsum(inside[:len(where)]).astype(bool)
        head = inside.copy()
        head[1:] &= (where[1:] != where[:-1]) | ~inside[:-1]
        first = np.flatnonzero(head)
        stop = inside.copy()
        stop[:-1] &= head[1:] | ~inside[1:]
        self.first, self.count = first, np.flatnonzero(stop) - first + 1
        self.where = where[first]
        self.doc = np.searchsorted(self.starts, first, side="right") - 1
        self.anchor = hashes[self.where]
        with np.errstate(over="ignore"):
            self.content = K.mix(prefix.ranges(first, first + self.count + span - 1) + (self.where - first).astype(np.uint64))


def first_of_equal(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in the order of (keys, doc, at), and for each whether it is the first of its keys."""
    order = np.lexsort((at, doc, *reversed(keys)))
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, head


def later(order: np.ndarray, head: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes that repeat an earlier one: not the first of their keys, nor at the very place of the first."""
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    return order[(doc[order] != doc[lead]) | (at[order] != at[lead])]


def union(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of each document."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 40
    upto = np.maximum.accumulate(end + rank)
    head = np.ones(len(doc), bool)
    head[1:] = begin[1:] + rank[1:] > upto[:-1]
    at = np.flatnonzero(head)
    return doc[at], begin[at], (upto - rank)[np.append(at[1:], len(doc)) - 1]


def symbols(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out |= buf[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def refine(buf: np.ndarray, at: np.ndarray, interval: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: windows buf[at:at+span] in intervals; returns the windows that are left in an
    interval of several after span bytes (indexes, sorted by interval), and their intervals."""
    left = np.argsort(interval, kind="stable")
    interval = interval[left]
    steps = [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]
    for step in [None, *steps]:
        if step is not None:
            symbol = symbols(buf, at[left] + step)
            order = np.lexsort((symbol, interval))
            left, symbol, interval = left[order], symbol[order], interval[order]
            head = np.ones(len(left), bool)
            head[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
            interval = np.cumsum(head)
        size = np.bincount(interval) if len(interval) else np.zeros(1, np.int64)
        several = size[interval] > 1
        left, interval = left[several], interval[several]
    return left, interval


def _shard(documents: DataFrame, parts: int, span: int, gram: int) -> DataFrame:
    fields = RUNS | CUTS

    def send(held: list):
        anchor, content, of, at, n = (np.concatenate(x) for x in zip(*held))
        order, head = first_of_equal([anchor, content], of, at)
        again = later(order, head, of, at)
        cuts = union(of[again], at[again], at[again] + n[again] + span - 1)
        keep = order[head]
        return deal((anchor[keep] % np.uint64(parts)).astype(np.int64), parts, fields,
                    dict(zip(RUNS, (anchor[keep], content[keep], of[keep], at[keep], n[keep]))), dict(zip(CUTS, cuts)))

    def run(batches):
        held, total = [], 0
        for pdf in batches:
            pdf = pdf[pdf["doc_id"].notna()]
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            for a, b in K.slices(texts):
                r = Runs(texts[a:b], span, gram)
                held.append((r.anchor, r.content, ids[a:b][r.doc], r.first - r.starts[r.doc], r.count))
                total += len(r.doc)
                if total > FLUSH:
                    yield send(held)
                    held, total = [], 0
        if total:
            yield send(held)
    return map_frames(documents.select("doc_id", "text"), run, schema(fields))


def _meet(runs: DataFrame, parts: int, span: int) -> DataFrame:
    """Ranges to cut, and the runs whose bytes are wanted, by document."""
    fields = {f"cut_{k}": v for k, v in CUTS.items()} | WANTED

    def run(batches):
        x = gather(batches, RUNS | CUTS)
        order, head = first_of_equal([x["anchor"], x["content"]], x["of"], x["at"])
        again, keep = later(order, head, x["of"], x["at"]), order[head]
        doc, begin, end = union(np.concatenate([x["doc"], x["of"][again]]), np.concatenate([x["begin"], x["at"][again]]),
                                np.concatenate([x["end"], x["at"][again] + x["n"][again] + span - 1]))
        anchor = x["anchor"][keep]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group] if len(group) else group
        open_ = keep[size > 1]
        yield deal(x["of"][open_] % parts, parts, fields,
                   {"of": x["of"][open_], "at": x["at"][open_], "n": x["n"][open_], "anchor": x["anchor"][open_], "hot": size[size > 1] > HOT})
        yield deal(doc % parts, parts, fields, dict(zip((f"cut_{k}" for k in CUTS), (doc, begin, end))))
    return by_part(runs, parts).mapInPandas(run, schema(fields))


def _per_document(rows: DataFrame, parts: int) -> DataFrame:
    """doc_id, packed ranges to cut, packed runs that are wanted."""
    fields = {f"cut_{k}": v for k, v in CUTS.items()} | WANTED

    def run(batches):
        x = gather(batches, fields)
        doc, begin, end = union(x["cut_doc"], x["cut_begin"], x["cut_end"])
        order = np.argsort(x["of"], kind="stable")
        of = x["of"][order]
        ids = np.union1d(doc, of)
        c, w = np.searchsorted(doc, np.append(ids, np.iinfo(np.int64).max)), np.searchsorted(of, np.append(ids, np.iinfo(np.int64).max))
        pick = lambda name: x[name][order].astype("<i8")
        wanted = np.stack([pick("at"), pick("n"), x["anchor"][order].view("<i8"), pick("hot")], axis=1)
        cuts = np.stack([begin, end], axis=1)
        yield pd.DataFrame({"doc_id": ids, "cuts": [cuts[c[i]:c[i + 1]].tobytes() for i in range(len(ids))],
                            "wanted": [wanted[w[i]:w[i + 1]].tobytes() for i in range(len(ids))]})
    return by_part(rows, parts).mapInPandas(run, "doc_id long, cuts binary, wanted binary")


def _fetch(texts: DataFrame, parts: int, span: int, gram: int) -> DataFrame:
    """Bytes of the wanted runs, dealt by anchor; windows of hot anchors, dealt by their hash."""
    fields = BYTES | {f"cut_{k}": v for k, v in CUTS.items()}

    def send(held):
        out = []
        of, at, n, anchor, hot, bufs = (np.concatenate([h[i] for h in held]) if i < 5 else [h[5] for h in held] for i in range(6))
        data = np.concatenate([b[0] for b in bufs])
        base = np.concatenate([[0], np.cumsum([len(b[0]) for b in bufs])])[:-1]
        start = np.concatenate([b[1] + o for b, o in zip(bufs, base)])  # of each run, in data
        length = n + span - 1
        part = (anchor % np.uint64(parts)).astype(np.int64)
        cold = np.flatnonzero(hot == 0)
        cold = cold[np.argsort(part[cold], kind="stable")]
        cut = np.searchsorted(part[cold], np.arange(parts + 1))
        for p in range(parts):
            some = cold[cut[p]:cut[p + 1]]
            if len(some):
                flat = np.repeat(start[some] - (np.cumsum(length[some]) - length[some]), length[some]) + np.arange(length[some].sum())
                row = {"anchor": anchor[some], "of": of[some], "at": at[some], "n": n[some], "bytes": data[flat]}
                out.append({"part": p} | {k: (row[k].astype(v).tobytes() if k in row else b"") for k, v in fields.items()})
        frames = [pd.DataFrame(out)] if out else []
        warm = np.flatnonzero(hot)
        if len(warm):
            inner = np.arange(n[warm].sum()) - np.repeat(np.cumsum(n[warm]) - n[warm], n[warm])
            owner = np.repeat(warm, n[warm])
            key = K.byte_prefix(data).ranges(start[owner] + inner, start[owner] + inner + span)
            d, a = of[owner], at[owner] + inner
            order, head = first_of_equal([key], d, a)
            again, keep = later(order, head, d, a), order[head]
            cuts = union(d[again], a[again], a[again] + span)
            frames.append(deal((key[keep] % np.uint64(parts)).astype(np.int64), parts, fields,
                               {"key": key[keep], "key_of": d[keep], "key_at": a[keep]}, {f"cut_{k}": v for k, v in zip(CUTS, cuts)}))
        return frames

    def run(batches):
        held, total = [], 0
        for pdf in batches:
            for doc, text, wanted in zip(pdf["doc_id"], pdf["text"], pdf["wanted"]):
                data = np.frombuffer(("" if text is None else text).encode("utf-8", "surrogatepass"), np.uint8)
                at, n, anchor, hot = np.frombuffer(wanted, "<i8").reshape(-1, 4).T
                fits = at + n + span - 1 <= len(data)  # another row of the same id may be shorter
                at, n, anchor, hot = at[fits], n[fits], anchor[fits], hot[fits]
                if not len(at):
                    continue
                length = n + span - 1
                offset = np.cumsum(length) - length
                flat = np.repeat(at - offset, length) + np.arange(length.sum())
                held.append((np.full(len(at), doc, np.int64), at, n, anchor.view(np.uint64), hot, (data[flat], offset)))
                total += int(length.sum())
                if total > 16_000_000:
                    yield from send(held)
                    held, total = [], 0
        if held:
            yield from send(held)
    return texts.mapInPandas(run, schema(fields))


def slabs(edges: np.ndarray, upto: np.ndarray, limit: int = SLAB):
    """Slices of whole groups (edges: their first items; upto: running sum of their weights) of about limit weight."""
    first = 0
    for e, nxt in zip(edges, np.append(edges[1:], len(upto))):
        before = upto[first - 1] if first else 0
        if upto[nxt - 1] - before >= limit or nxt == len(upto):
            yield slice(first, nxt)
            first = nxt


def _refined(x: dict, runs: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the windows of these runs that repeat an earlier one of the same runs."""
    n = x["n"][runs].astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    anchors = np.unique(x["anchor"][runs], return_inverse=True)[1]
    left, interval = refine(x["bytes"], start[owner] + inner, anchors[owner], span)
    d, a = x["of"][runs][owner[left]], (x["at"][runs][owner] + inner)[left]
    order, head = first_of_equal([interval], d, a)
    again = later(order, head, d, a)
    return d[again], a[again], a[again] + span


def _merge(rows: DataFrame, parts: int, span: int) -> DataFrame:
    """Ranges to cut that the interleave refinement of the fetched windows finds."""
    fields = BYTES | {f"cut_{k}": v for k, v in CUTS.items()}

    def run(batches):
        x = gather(batches, fields)
        # the runs of one sender lie one after another, and so do their bytes
        length = x["n"].astype(np.int64) + span - 1
        start, order = np.cumsum(length) - length, np.argsort(x["anchor"], kind="stable")
        anchor = x["anchor"][order]
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        upto = np.cumsum(x["n"][order].astype(np.int64))
        found = [(x["cut_doc"], x["cut_begin"], x["cut_end"])]
        for some in slabs(edges, upto):
            runs = order[some]
            found.append(_refined(x, runs, start[runs], span))
        order, head = first_of_equal([x["key"]], x["key_of"], x["key_at"])
        again = later(order, head, x["key_of"], x["key_at"])
        found.append((x["key_of"][again], x["key_at"][again], x["key_at"][again] + span))
        doc, begin, end = union(*(np.concatenate(c) for c in zip(*found)))
        yield deal(doc % parts, parts, {f"cut_{k}": v for k, v in CUTS.items()}, dict(zip((f"cut_{k}" for k in CUTS), (doc, begin, end))))
    return by_part(rows, parts).mapInPandas(run, schema({f"cut_{k}": v for k, v in CUTS.items()}))


def repeated_ranges(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> Table:
    """Table of doc_id and its packed maximal ranges (int64 begin, end) of bytes in a string of span bytes that
    also starts earlier (in a smaller doc_id, or in the same document before)."""
    parts = partitions(documents.sparkSession)
    known = Table(_per_document(_meet(_shard(documents, parts, span, gram), parts, span), parts))
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text").join(
        known.df.where(F.length("wanted") > 0).select("doc_id", "wanted"), "doc_id")
    merged = _merge(_fetch(texts, parts, span, gram), parts, span)
    fields = {f"cut_{k}": v for k, v in CUTS.items()}

    def repack(batches):
        for pdf in batches:
            cuts = [np.frombuffer(c, "<i8").reshape(-1, 2) for c in pdf["cuts"]]
            doc = np.repeat(pdf["doc_id"].to_numpy(np.int64), [len(c) for c in cuts])
            both = np.concatenate([*cuts, np.zeros((0, 2), np.int64)])
            yield deal(doc % parts, parts, fields, {"cut_doc": doc, "cut_begin": both[:, 0], "cut_end": both[:, 1]})

    def last(batches):
        x = gather(batches, fields)
        doc, begin, end = union(x["cut_doc"], x["cut_begin"], x["cut_end"])
        ids, at = np.unique(doc, return_index=True)
        both, at = np.stack([begin, end], axis=1).astype("<i8"), np.append(at, len(doc))
        yield pd.DataFrame({"doc_id": ids, "cuts": [both[at[i]:at[i + 1]].tobytes() for i in range(len(ids))]})

    rows = known.df.select("doc_id", "cuts").mapInPandas(repack, schema(fields)).unionByName(merged)
    out = Table(by_part(rows, parts).mapInPandas(last, "doc_id long, cuts binary"))
    known.drop()
    return out


def remove_repeats(documents: DataFrame, span: int = SPAN, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    ranges = repeated_ranges(documents, span, gram)

    def run(batches):
        for pdf in batches:
            out = []
            for text, cuts in zip(pdf["text"], pdf["cuts"]):
                data = ("" if text is None else text).encode("utf-8", "surrogatepass")
                pairs = [] if cuts is None else [(a, min(b, len(data))) for a, b in np.frombuffer(cuts, "<i8").reshape(-1, 2).tolist() if a < len(data)]
                kept, upto = [], 0
                for a, b in pairs:
                    kept.append(data[upto:a])
                    upto = b
                kept = b"".join([*kept, data[upto:]])
                out.append((len(data), len(data) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return map_frames(documents.select("doc_id", "text").join(small(ranges.df), "doc_id", "left"), run, shape)
