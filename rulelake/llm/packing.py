"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token streams.  Service goes round in slots of ``quantum`` tokens: a queue with target
weight w earns credit in proportion to w, slot j of it falls due at virtual time (2j + 1) / w, and slots are taken
in that order (ties: queue number).  Credit that a window could not spend is carried to the next; a queue that has
run dry stops earning and the others keep their ratio.  Because due times are closed forms, the place of any slot
is a sum over the queues, computed in integers: no pass over the data is sequential, and the deficits carry across
windows and partitions exactly as one sequential round-robin would carry them.

The windows are 1024 tokens; what remains at the very end is cut into powers of two, so nothing is padded.

Memory: one partition's Arrow batches, the word table, and arrays of one number per queue.  Every source has its own
queue, however many there are; beyond ``max_queues`` the places of slots that lie close together are counted off in
one sorted stretch of the stream instead of one sum over the queues for each.  Defined results: null and empty texts
are one token (the end id); repeated rows are packed each; a null source is a queue of its own (shown as '', as is
the queue of the source ''); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .frames import map_frames
from .storage import Table, small

WINDOW, QUANTUM, MAX_QUEUES = 1024, 128, 256
#: Slots that one stretch of the stream counts off at most.
STRETCH = 1 << 20
_ENCODERS: dict[str, tokens.Encoder] = {}


def encoder(path: str) -> tokens.Encoder:
    """One per worker process, so that its word table serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = tokens.Encoder(path)
    return _ENCODERS[path]


def encoded(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, queue ('=' and the source, '' for null), n, ids (little-endian unsigned), and the place in its queue
    within the block."""
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))

    def run(batches):
        from pyspark import TaskContext

        block, upto = TaskContext.get().partitionId(), {}
        enc = encoder(vocabulary)
        kind = np.dtype("<u2") if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in K.slices(texts):
                ids, cut = enc.ids(texts[a:b])
                ids = ids.astype(kind)
                tail = np.array([end_id], kind).tobytes()
                part = pdf.iloc[a:b]
                n = np.diff(cut) + 1
                at = np.zeros(b - a, np.int64)
                for q, rows in part.reset_index(drop=True).groupby("queue").indices.items():
                    run_n = np.cumsum(n[rows])
                    at[rows] = upto.get(q, 0) + run_n - n[rows]
                    upto[q] = upto.get(q, 0) + int(run_n[-1])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "queue": part["queue"].to_numpy(), "block": block, "at": at, "n": n,
                                    "ids": [ids[x:y].tobytes() + tail for x, y in zip(cut[:-1], cut[1:])]})
    return map_frames(documents.select("doc_id", queue.alias("queue"), "text"), run, "doc_id long, queue string, block int, at long, n long, ids binary")


class Schedule:
    """Where each slot of each queue lies in the one global token stream."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, quantum: int, window: int, max_queues: int = MAX_QUEUES):
        self.totals, self.weights, self.quantum, self.window = totals, weights, quantum, window
        self.max_queues, self.slots = max_queues, -(-totals // quantum)
        self.total = int(totals.sum())
        rest, ends = self.total % window, []
        while rest:
            ends.append(1 << (rest.bit_length() - 1))
            rest -= ends[-1]
        self.tail = self.total - self.total % window + np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)

    def places(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Tokens that are served before the slot."""
        if len(self.totals) <= self.max_queues or not len(slot):
            return self._each(queue, slot)
        out = np.zeros(len(slot), np.int64)
        # quotients of 53 bits tell any two due times apart while 2 * slots * weight is below 2**52
        exact = int(2 * self.slots.max() + 1) * int(self.weights.max()) < 1 << 52
        order = np.lexsort((queue, (2 * slot + 1) / self.weights[queue]))
        todo = [order] if exact else [order[i:i + 1] for i in range(len(order))]
        while todo:
            some = todo.pop()
            first, last = self._before(queue[some[0]], slot[some[0]]), self._before(queue[some[-1]], slot[some[-1]])
            n = last - first
            if len(some) == 1:
                out[some] = self._served(first)
            elif n.sum() <= STRETCH and n.sum() <= len(some) * len(n):
                out[some] = self._stretch(queue[some], slot[some], first, n)
            else:
                todo += [some[:len(some) // 2], some[len(some) // 2:]]
        return out

    def _before(self, queue: int, slot: int) -> np.ndarray:
        """Of each queue, how many slots come before this one."""
        own, r = self.weights[queue], np.arange(len(self.totals))
        x = (2 * slot + 1) * self.weights - own
        before = np.where(r < queue, x // (2 * own) + 1, -((-x) // (2 * own)))
        before[queue] = slot
        return np.minimum(np.maximum(before, 0), self.slots)

    def _served(self, before: np.ndarray) -> int:
        return int(np.minimum(before * self.quantum, self.totals).sum())

    def _stretch(self, queue: np.ndarray, slot: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of slots in the order of the stream, counted off over all n slots of each queue from the first."""
        r = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + first[r]
        order = np.lexsort((r, (2 * j + 1) / self.weights[r]))
        upto = np.zeros(len(r) + 1, np.int64)
        np.cumsum(np.minimum(self.quantum, self.totals[r] - j * self.quantum)[order], out=upto[1:])
        rank = np.empty(len(r) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(r)), len(r)
        at = (np.cumsum(n) - n)[queue] + slot - first[queue]
        at[slot >= (first + n)[queue]] = len(r)  # the last one itself comes after all of these
        return self._served(first) + upto[rank[at]]

    def _each(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        out = np.zeros(len(slot), np.int64)
        due = 2 * slot + 1
        own = self.weights[queue]
        for r, (total, w) in enumerate(zip(self.totals, self.weights)):
            x = due * w - own
            before = np.where(r < queue, x // (2 * own) + 1, -((-x) // (2 * own)))
            before = np.where(r == queue, slot, np.maximum(before, 0))
            out += np.minimum(before * self.quantum, total)
        return out

    def sequences(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, begin and end of the sequence that holds each place."""
        full = self.total // self.window
        number = place // self.window
        begin, end = number * self.window, (number + 1) * self.window
        late = number >= full
        if late.any():
            k = np.searchsorted(self.tail, place[late], side="right") - 1
            number[late], begin[late], end[late] = full + k, self.tail[k], self.tail[k + 1]
        return number, begin, end

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray):
        """Cuts of documents at [at, at + n) of their queues: document, start, length, sequence, offset."""
        q = self.quantum
        first, count = at // q, (at + n - 1) // q - at // q + 1
        doc = np.repeat(np.arange(len(at)), count)
        slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        begin = np.maximum(at[doc], slot * q)
        end = np.minimum((at + n)[doc], (slot + 1) * q)
        place = self.places(queue[doc], slot) + begin - slot * q
        begin, end = begin - at[doc], end - at[doc]
        done = []
        while len(doc):
            number, low, high = self.sequences(place)
            size = np.minimum(end - begin, high - place)
            done.append((doc, begin, size, number, place - low))
            go = begin + size < end
            doc, begin, end, place = doc[go], (begin + size)[go], end[go], (place + size)[go]
        doc, begin, size, number, offset = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((begin, doc))
        doc, begin, size, number, offset = doc[order], begin[order], size[order], number[order], offset[order]
        # slots of one queue that follow each other in a sequence are one piece
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + size[:-1])
        head = np.flatnonzero(fresh)
        return doc[head], begin[head], np.add.reduceat(size, head), number[head], offset[head]


def integer_weights(totals: np.ndarray, targets: np.ndarray | None) -> np.ndarray:
    """Targets (by default the queues' own token shares) as integers up to 2**20."""
    share = totals if targets is None else targets
    return np.maximum(1, np.round(share / max(share.max(), 1e-300) * (1 << 20))).astype(np.int64)


def pack(documents: DataFrame, vocabulary: str | None = None, targets: dict[str, float] | None = None,
         window: int = WINDOW, quantum: int = QUANTUM, end_id: int = 0, max_queues: int = MAX_QUEUES,
         with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and source queue, ids).

    targets gives token proportions by source (missing sources get the smallest given one); by default each
    source's share of all tokens, which every window then holds until the end.
    """
    staged = Table(encoded(documents, vocabulary or tokens.vocabulary(), end_id))
    per_block = staged.df.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    sums = {r.queue: r.n for r in staged.df.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row a source
    names = sorted(sums)
    totals = np.array([sums[q] for q in names], np.int64)
    aim = None if targets is None else np.array([targets.get(q[1:], min(targets.values())) for q in names], float)
    schedule = Schedule(totals, integer_weights(totals, aim), quantum, window, max_queues) if names else None
    number = {q: i for i, q in enumerate(names)}
    offsets = per_block.withColumn("base", F.sum("n").over(
        Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select(
        "queue", "block", F.coalesce("base", F.lit(0)).alias("base"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            queue = pdf["queue"].map(number).to_numpy(np.int64)
            doc, begin, size, seq, offset = schedule.pieces(queue, (pdf["at"] + pdf["base"]).to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
            blobs, n = pdf["ids"].tolist(), pdf["n"].to_numpy()
            wide = [np.frombuffer(x, f"<u{len(x) // k}").astype("<u4").tobytes() for x, k in zip(blobs, n)]
            cuts = [wide[d][4 * s:4 * (s + k)] for d, s, k in zip(doc.tolist(), begin.tolist(), size.tolist())]
            out = {"doc_id": pdf["doc_id"].to_numpy()[doc], "start": begin, "length": size,
                   "ids_crc32": np.array([zlib.crc32(x) for x in cuts], np.int64), "doc_tokens": n[doc],
                   "sequence_id": seq, "offset": offset, "queue": pdf["queue"].str[1:].to_numpy()[doc]}
            yield pd.DataFrame(out | ({"ids": cuts} if with_ids else {}))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return map_frames(staged.df.join(small(offsets), ["queue", "block"]), run, schema + (", ids binary" if with_ids else ""))
