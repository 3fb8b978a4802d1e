"""Many needles in one pass over each text: each text is read and carried once, however many needles there are.

A few needles are one expression each in one projection, which stays in the JVM.  More become an automaton (Aho and
Corasick) that each worker builds once and runs along every text of its Arrow batches; it costs the same per character
with ten or ten thousand needles.  Beyond MOST they stay a table: a bitmap of bounded size turns away the windows of the
texts that are no needle, and what is left is joined with the table, which no driver and no task holds whole.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences

#: Needles up to which each is an expression of its own.
FEW = 24
#: Needles up to which one automaton holds them all.
MOST = 100_000
#: Slots of the bitmap (a power of two; 16 MB), and factors of the hash that names a slot.
SLOT_BITS = 27
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def usable(needle: str | None) -> bool:
    """A needle that can occur in a line."""
    return bool(needle) and "\n" not in needle


def times(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a needle; texts without any are not copied."""
    return F.when(F.contains(text, F.lit(needle)), occurrences(text, F.lit(needle))).otherwise(F.lit(0).cast("long"))


@functools.lru_cache(maxsize=4)
def _automaton(needles: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        out.add_word(needle, (i, len(needle)))
    out.make_automaton()
    return out


def matches(text: str, needles: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(needle, start) of each needle's non-overlapping occurrences, the leftmost first."""
    upto: dict[int, int] = {}
    for last, (i, n) in _automaton(needles).iter(text):
        start = last - n + 1
        if start >= upto.get(i, 0):
            upto[i] = last + 1
            yield i, start


def found(files: DataFrame, needles: Sequence[str], by_line: bool) -> DataFrame:
    """files (file, text) to (file, n_lines, line_no, needle, n): occurrences by number of the needle, in each line that has
    some, or over the whole text (line_no 0). Needles with a line end, empty and repeated ones are the caller's."""
    told = tuple(needles)
    schema = pa.schema([("file", pa.string()), ("n_lines", pa.int32()), ("line_no", pa.int32()), ("needle", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                counts: dict[tuple[int, int], int] = {}
                ends = None
                for i, start in matches(text, told):
                    if by_line and ends is None:
                        ends = [k for k, c in enumerate(text) if c == "\n"]
                    key = (bisect_right(ends, start) + 1 if by_line else 0, i)
                    counts[key] = counts.get(key, 0) + 1
                if counts:
                    n_lines = text.count("\n") + 1
                    for (line, i), n in counts.items():
                        for column, value in zip(out, (at, n_lines, line, i, n)):
                            column.append(value)
            files_ = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([files_, *[pa.array(v, f.type) for v, f in zip(out[1:], list(schema)[1:])]], schema=schema)
    return files.select(F.col("file").cast("string").alias("file"), "text").mapInArrow(run, "file string, n_lines int, line_no int, needle int, n long")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * MIX) >> np.uint64(64 - SLOT_BITS)


def candidates(text: str, alphabet: np.ndarray, lengths: Sequence[int], bitmap: np.ndarray) -> Iterator[tuple[str, int]]:
    """(window, start) of a text's windows of the given lengths (ascending) that may be needles, by start for each length:
    all their characters occur in needles, and their slot is taken. Every needle that occurs is among them."""
    code = codes(text)
    held = alphabet[code]
    at = np.flatnonzero(held)
    stops = np.append(np.flatnonzero(~held), len(code))
    left = stops[np.searchsorted(stops, at)] - at
    hashes, done = np.zeros(len(at), np.uint64), 0
    for n in lengths:
        at, left, hashes = (x[keep] for keep in [left >= n] for x in (at, left, hashes))
        for k in range(done, n):
            hashes = hashes * BASE + code[at + k]
        done, slot = n, slots(hashes)
        for start in at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1].tolist():
            yield text[start:start + n], start


def windows(files: DataFrame, table: DataFrame, by_line: bool) -> DataFrame:
    """As found(), for a table of distinct usable needles (needle) of any size; needle is the needle itself. The driver
    holds a bitmap of the needles' slots, their lengths and their characters."""
    def hashed(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, needle in enumerate(batch.column(0).to_pylist()):
                for c in codes(needle).tolist():
                    out[i] = (int(out[i]) * int(BASE) + c) & 0xFFFFFFFFFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(slots(out).astype(np.int64))], ["slot"])
    bitmap = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    blocks = table.select("needle").mapInArrow(hashed, "slot long").groupBy(F.expr("shiftright(slot, 15)").alias("block")).agg(F.bitmap_construct_agg(F.expr("slot & 32767")).alias("bits"))
    for r in blocks.toLocalIterator():
        bitmap[r.block << 12:(r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    lengths = sorted(r[0] for r in table.select(F.length("needle")).distinct().collect())  # no more than the longest needle has characters
    alphabet = np.zeros(0x110000, bool)
    alphabet[[ord(r[0]) for r in table.select(F.explode(F.split("needle", ""))).distinct().collect() if r[0]]] = True
    shared = files.sparkSession.sparkContext.broadcast((alphabet, lengths, bitmap))
    schema = pa.schema([("file", pa.string()), ("n_lines", pa.int32()), ("line_no", pa.int32()), ("needle", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                counts: dict[tuple[int, str], int] = {}
                upto: dict[str, int] = {}
                ends = None
                for needle, start in candidates(text, *shared.value):
                    if start < upto.get(needle, 0):
                        continue
                    upto[needle] = start + len(needle)
                    if by_line and ends is None:
                        ends = [k for k, c in enumerate(text) if c == "\n"]
                    key = (bisect_right(ends, start) + 1 if by_line else 0, needle)
                    counts[key] = counts.get(key, 0) + 1
                n_lines = text.count("\n") + 1
                for (line, needle), n in counts.items():
                    for column, value in zip(out, (at, n_lines, line, needle, n)):
                        column.append(value)
            files_ = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([files_, *[pa.array(v, f.type) for v, f in zip(out[1:], list(schema)[1:])]], schema=schema)
    return files.select(F.col("file").cast("string").alias("file"), "text").mapInArrow(run, "file string, n_lines int, line_no int, needle string, n long")


def present(files: DataFrame, needles: Sequence[str], absent: bool = False) -> DataFrame:
    """(file, pattern) of the needles that a file's text has (or lacks); texts that are null have and lack nothing."""
    distinct = list(dict.fromkeys(needles))
    if len(distinct) <= FEW or not available():
        held = F.filter(F.array(*map(F.lit, distinct)).cast("array<string>"), lambda p: ~F.contains("text", p) if absent else F.contains("text", p))
        return files.select("file", F.explode(held).alias("pattern"))
    some = tuple(p for p in distinct if p)
    key = dict(files.dtypes)["file"]

    def run(batches):
        automaton = _automaton(some)
        for batch in batches:
            rows, patterns = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                has = {some[i] for _, (i, _) in automaton.iter(text)} | ({""} & set(distinct))
                told = [p for p in distinct if (p in has) != absent]
                rows += [at] * len(told)
                patterns += told
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(patterns, pa.string())], ["file", "pattern"])
    return files.select("file", "text").mapInArrow(run, f"file {key}, pattern string")


def available() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True
