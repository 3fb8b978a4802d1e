"""Vectorised text kernels shared by the operators (numpy over whole Arrow batches, no per-row loops over bytes).

A batch of texts becomes one byte buffer with document offsets.  Hashes of any byte range come from one
polynomial prefix sum modulo 2**64 over randomised byte codes, followed by a mixing step, so the hash of every
word, shingle or window is a subtraction and a multiplication.  Equal strings always hash alike; different
strings collide with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: [^\x20\x09-\x0D] : bytes of words cut at white space.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
#: [0-9A-Za-z] and everything from 0x80: bytes of words cut at punctuation.
PLAIN_WORD = np.zeros(256, bool)
PLAIN_WORD[48:58] = PLAIN_WORD[65:91] = PLAIN_WORD[97:123] = PLAIN_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        step = base
        while have < n:
            take = min(have, n - have)
            out[have:have + take] = out[:take] * step
            step = step * step
            have += take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
#: Powers that are kept between batches; a longer text makes its own.
KEPT_POWERS = 1 << 22


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """Like powers(), kept between batches."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = powers(max(n, 1 << 16), base)
        if n <= KEPT_POWERS:
            _POWERS[int(base)] = have
    return have[:n]


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: None


def release() -> None:
    """Gives freed memory back to the system: Python workers live on after their task and would keep it."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    _trim()(0)


class Prefix:
    """Prefix sums from which the hash of any range of a sequence of uint64 codes is read off."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * _powers(n, _BASE), out=self.sums[1:])
        self.back = _powers(n + 1, _INV)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def byte_prefix(buf: np.ndarray) -> Prefix:
    return Prefix(_CODES[buf])


def buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and len(texts)+1 offsets; null counts as empty. Documents are separated by one newline."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.zeros(0, np.uint8), starts


def words(buf: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of allowed bytes. The newline between documents always cuts."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = allowed[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def per_doc(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie before each document start: offsets into them."""
    return np.searchsorted(positions, starts)


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The document number of each item, from offsets into the items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def word_shingles(buf: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and the documents' offsets into them.

    Words are cut at white space and lower-cased over A-Z; a document with 1..size-1 words has the hash of its
    whole sequence, one without words has none.
    """
    first, last = words(buf, SPACE_WORD)
    hashes = byte_prefix(LOWER[buf]).ranges(first, last)
    cut = per_doc(first, starts)
    counts = np.diff(cut)
    prefix = Prefix(hashes)
    doc = doc_of(cut)
    at = np.arange(len(hashes))
    length = np.minimum(size, counts[doc])
    keep = at + length <= cut[1:][doc]
    grams, doc = prefix.ranges(at[keep], at[keep] + length[keep]), doc[keep]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[fresh], doc[fresh]
    return grams, np.searchsorted(doc, np.arange(len(starts)))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of values between consecutive offsets."""
    with np.errstate(over="ignore"):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=run[1:])
        return run[offsets[1:]] - run[offsets[:-1]]


def slices(texts, limit: int = 1_000_000):
    """Index ranges of texts so that each has about limit characters (one long text stands alone)."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)
    release()
