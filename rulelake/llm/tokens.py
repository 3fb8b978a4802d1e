"""Byte-level BPE ids of whole texts, word by word.

The pre-tokeniser of the vocabulary cuts a text into words that are encoded independently.  Here the cuts of a
whole batch are found with array operations on code points; each distinct word goes to the ``tokenizers`` library
once and its ids are kept in a bounded table, so a text costs a table lookup per word.
"""

from __future__ import annotations

import numpy as np
import regex

from . import kernels as K

#: Entries of the word table; it is emptied when half full (about 100 MB with its ids).
SLOTS = 1 << 21


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for n, kind in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(kind, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a:b + 1] = n
    out[0xD800:0xE000] = 0
    return out


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points and the offsets of the texts in them; null counts as empty."""
    parts = [b"" if t is None else t.encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint32), starts


class Cutter:
    """Word starts as the byte-level pre-tokeniser's pattern sets them: contractions, then an optional blank
    before letters, numbers or others, then white space that leaves its last character to a following word."""

    def __init__(self):
        self.classes = _classes()

    def starts(self, cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[cp]
        first = np.zeros(n + 4, bool)
        first[docs[:-1][docs[:-1] < n]] = True
        first[n:] = True
        cut = first.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:n])
        cut[last] = True
        cut[last + 1] = cp[last] != 32
        at = np.flatnonzero((cp == 39) & cut[:n])
        if len(at):
            wide = np.zeros(n + 3, np.uint32)
            wide[:n] = cp
            a, b = wide[at + 1], wide[at + 2]
            a, b = np.where(first[at + 1], 0, a), np.where(first[at + 1] | first[at + 2], 0, b)
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            cut[at[two] + 1] = False
            cut[at[two] + 2] = True
            cut[at[three] + 1] = cut[at[three] + 2] = False
            cut[at[three] + 3] = True
        return np.flatnonzero(cut[:n])


class WordTable:
    """64-bit word hashes to row numbers, by open addressing over arrays."""

    def __init__(self, slots: int = SLOTS):
        self.size = slots
        self.shift = np.uint64(64 - int(np.log2(slots)))
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.n = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        out = np.full(len(keys), -1, np.int64)
        at = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            same = there == keys
            out[left[same]] = self.rows[at[same]]
            go = ~same & (there != 0)
            left, keys, at = left[go], keys[go], (at[go] + 1) % self.size
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not there."""
        self.n += len(keys)
        at = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            slot, which = np.unique(at[free], return_index=True)
            taken = free[which]
            self.keys[slot], self.rows[slot] = keys[taken], rows[taken]
            go = np.ones(len(keys), bool)
            go[taken] = False
            keys, rows, at = keys[go], rows[go], at[go]
            at = np.where(self.keys[at] != 0, (at + 1) % self.size, at)


class Growing:
    """An array with room to append."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def append(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(more)] = more
        self.n += len(more)


class Words:
    """Words of a batch of texts as rows of the encoder's table, and the texts' offsets in them."""

    def __init__(self, rows: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.rows, self.offsets, self.starts, self.ends = rows, offsets, starts, ends


class Encoder:
    """ids() equals Tokenizer.encode(text, add_special_tokens=False).ids for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cutter, self.table = Cutter(), WordTable()
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.pool, self.begin = Growing(np.int32), Growing(np.int64)
        self.begin.append(np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Appends the words' ids to the pool, in order."""
        for a in range(0, len(words), 4096):
            some = words[a:a + 4096]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(got.word_ids, np.int64)
            counts = np.bincount(owner, minlength=len(some))
            ends = self.begin.data[self.begin.n - 1] + np.cumsum(counts)
            self.pool.append(np.array(got.ids, np.int32))
            self.begin.append(ends)

    def parts(self, texts):
        """Words of all texts in consecutive parts, none with more words than half the table holds. The table's
        rows that a part names are valid until the next part is taken."""
        cp, docs = code_points(texts)
        starts = self.cutter.starts(cp, docs)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        prefix = K.Prefix(cp.astype(np.uint64) + np.uint64(1))
        offsets, step = np.searchsorted(starts, docs), self.table.size // 2
        for at in range(0, max(1, len(starts)), step):
            a, b = starts[at:at + step], ends[at:at + step]
            yield Words(self._rows(cp, prefix.ranges(a, b), a, b), np.clip(offsets - at, 0, len(a)), a, b)

    def _rows(self, cp: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.table.n > self.table.size // 2:
            self.clear()
        keys[keys == 0] = 1
        rows = self.table.find(keys)
        lost = np.flatnonzero(rows < 0)
        if len(lost):
            fresh, which, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            if self.table.n + len(fresh) > self.table.size * 3 // 4:
                self.clear()  # an empty table has room for all words of a part
                return self._rows(cp, keys, starts, ends)
            at = lost[which]
            base = self.begin.n - 1
            self._learn([cp[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[at], ends[at])])
            self.table.add(fresh, np.arange(base, base + len(fresh)))
            rows[lost] = base + back
        return rows

    def part_ids(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a part's words and the texts' offsets in them."""
        lo = self.begin.data[w.rows]
        n = self.begin.data[w.rows + 1] - lo
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return self.pool.data[np.arange(total[-1]) + np.repeat(lo - total[:-1], n)], total[w.offsets]

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the texts' offsets in them."""
        odd = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)]
        if odd:  # a special token's own string: the library cuts it out before the words
            texts = list(texts)
            direct = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd}
            for i in odd:
                texts[i] = None
        found = [self.part_ids(w) for w in self.parts(texts)]
        ids = np.concatenate([x for x, _ in found]) if len(found) > 1 else found[0][0]
        offsets = sum(x for _, x in found)
        if odd:
            parts = [direct[i] if i in direct else ids[offsets[i]:offsets[i + 1]] for i in range(len(texts))]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else ids
        return ids, offsets

    def counts(self, texts) -> np.ndarray:
        """Ids per text."""
        ids, offsets = self.ids(texts)
        return np.diff(offsets)
