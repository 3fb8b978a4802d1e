"""Similarity join of shingle sets with signature trees.

1. Sets are routed so that similar ones meet.  At high similarity every set is cut, by the value of its shingle
   hashes, into so many segments that two similar sets must agree on a whole non-empty one (pigeonhole over the
   largest possible difference at their size).  At lower similarity such segments would be small and passages that
   many documents share would tie unrelated ones; there the sets meet in their rarest shingles: the prefix of a
   global order by counted frequency, so long that two similar sets share an eighth of a set in it.  Only sets of
   similar size meet.  Pairs are made in groups of a few sets, and their meetings are added up over all partitions
   before any becomes a row: it must share that many.  A larger group is tied along its sizes.  What meets forms
   candidate components; nothing else can be similar.
2. A component's sets (equal sets once) go to one block, or to several of bounded volume.  In a block they form a
   signature tree: leaves hold a bitmap of hashed shingles, inner nodes the OR of their children's bitmaps and the
   range of set sizes.  A dual traversal compares nodes with nodes and drops a pair if the largest overlap that its
   bitmaps and sizes allow is below the least that similarity asks for, or if all sets below are connected already.
   Pairs of leaves that remain are compared exactly.
3. Components spread over several blocks are first connected through common members; those that still have parts
   are compared block by block, but never two sets of one part.

The links found span the graph of all links, so its connected components are exact (up to 64-bit hash collisions).
Documents that share a segment are never paired; a set meets the others only inside its blocks.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; rows with
the same doc_id are one node (one_of_each tells such rows apart by their texts); a null doc_id is reported with a null component and links with nothing; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import map_frames
from .blobs import by_part, deal, gather, schema
from .components import components
from .storage import Table, partitions, small, spread_join

#: Shingles of a block at most (a larger component has several), and common members of such blocks (about).
BLOCK_SHINGLES, HUBS = 2_000_000, 32
#: (key, document) pairs that a task holds before it sends them on.
FLUSH = 1_500_000
FAN = 8
#: Segments route sets only if they hold so many shingles on average.
WIDE = 8
#: Slots of counted shingles, by bits of their hash; only the order of the prefix depends on them. A shingle is common
#: from so many documents on.
SLOT_BITS, COMMON = 24, 3
#: Prefixes are longer by this share of a set, and two sets must share as much in them; groups of so many sets make pairs.
SHARED, FEW = 8, 8
#: The count of a tie that needs no other.
ENOUGH = 1 << 30
#: What meets in a partition: shingles (or segments), documents and their size buckets, and ties found before.
MEETING = {"key": "<u8", "doc": "<i8", "bucket": "<u1", "tied": "<i8", "to": "<i8"}
#: Pairs on their way to be added up: documents, the smaller size bucket, and how often they met.
PAIRS = {"a": "<i8", "b": "<i8", "bucket": "<u1", "n": "<i4"}


class Sizes:
    """Buckets of set sizes so that similar sets lie in one bucket or two adjacent ones; segments by bucket."""

    def __init__(self, percent: int):
        self.percent = percent
        bounds = [1, 2]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, 100 * (bounds[-1] - 1) // percent + 1))
        self.bounds = np.array(bounds, np.int64)
        differ = 2 * (self.bounds[1:] - 1) * (100 - percent) // (100 + percent)
        #: one more than needed, so that a set may leave out one empty segment
        self.segments = np.append(np.where(differ > 0, differ + 2, 0), 0)

    def bucket(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def least_overlap(self, a, b):
        """The least intersection of similar sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def segment_keys(grams: np.ndarray, cut: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' segments in their own and in the next bucket, and the number of the set of each."""
    n = np.diff(cut)
    doc, mixed = K.doc_of(cut), K.mix(grams + np.uint64(0x51ED27))
    keys, owners = [], []
    for step in (0, 1):
        bucket = sizes.bucket(np.maximum(n, 1)) + step
        k = np.where(n > 0, sizes.segments[bucket], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        use = k[doc] > 0
        part = ((grams >> np.uint64(32)) * k[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        held = np.bincount((base[doc] + part)[use], minlength=base[-1])
        sums = K.segment_sums(mixed[use], np.concatenate([[0], np.cumsum(held)]))
        owner = np.repeat(np.arange(len(n)), k)
        number = np.arange(base[-1]) - base[owner]
        with np.errstate(over="ignore"):
            key = K.mix(sums + K.mix((bucket[owner] << 40 | number).astype(np.uint64)))
        empty = held == 0
        # sets with one empty segment at most agree on a full one; the others meet in their empty ones too
        send = ~empty | (np.bincount(owner, empty, len(n))[owner] > 1)
        keys.append(key[send])
        owners.append(owner[send])
    return np.concatenate(keys), np.concatenate(owners)


def prefix_keys(grams: np.ndarray, cut: np.ndarray, sizes: Sizes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets' first shingles by (weight, hash), and the number of the set of each: so many that two similar sets
    share at least max(1, n // SHARED) of them, n being the smaller size."""
    n = np.diff(cut)
    doc = K.doc_of(cut)
    counted = grams < np.uint64(1 << 63)
    weight = np.where(counted, weights[(grams >> np.uint64(63 - SLOT_BITS)).astype(np.int64) & ((1 << SLOT_BITS) - 1)], 255)
    order = np.lexsort((weight, doc))  # stable: by hash within a weight
    first = (np.arange(len(grams)) - cut[:-1][doc]) < (n + (-sizes.percent * n) // 100 + np.maximum(1, n // SHARED))[doc]
    return grams[order[first]], doc[first]


def frequencies(documents: DataFrame, words: int) -> np.ndarray:
    """Weights of shingles by slot: 0 if rare, else the logarithm of the number of documents with the commonest shingle
    of the slot. Shingles with the lower half of the hash values are counted, exactly but for their last 31 bits; the
    prefixes hardly ever need others (these come last). The table has a fixed size, whatever the input."""
    parts = partitions(documents.sparkSession)
    edges = (np.arange(parts + 1) << SLOT_BITS) // parts
    low = 32 - SLOT_BITS

    def send(held: list):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(values >> np.uint32(low), edges)
        return pd.DataFrame({"part": np.arange(parts, dtype=np.int32), "values": [values[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])],
                             "n": [np.minimum(n[x:y], 255).astype(np.uint8).tobytes() for x, y in zip(cut[:-1], cut[1:])]})

    def count(batches):
        held, total = [], 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in K.slices(texts):
                grams, _ = K.word_shingles(*K.buffer(texts[a:b]), words)
                held.append((grams[grams < np.uint64(1 << 63)] >> np.uint64(31)).astype(np.uint32))
                total += len(held[-1])
                if total > FLUSH:
                    yield send(held)
                    held, total = [], 0
        if total:
            yield send(held)

    def add(batches):
        rows = pd.concat([*batches, pd.DataFrame({"part": [], "values": [], "n": []})])
        for part, some in rows.groupby("part"):
            part = int(part)
            values = np.frombuffer(b"".join(some["values"]), np.uint32)
            n = np.frombuffer(b"".join(some["n"]), np.uint8)
            order = np.argsort(values, kind="stable")
            values, n = values[order], n[order].astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            if not len(head):
                continue
            total = np.add.reduceat(n, head)
            common = total >= COMMON
            out = np.zeros(edges[part + 1] - edges[part], np.uint8)
            np.maximum.at(out, (values[head[common]] >> np.uint32(low)).astype(np.int64) - edges[part], np.log2(total[common]).astype(np.uint8))
            yield pd.DataFrame({"part": [np.int32(part)], "weights": [out.tobytes()]})

    rows = by_part(documents.select("text").mapInPandas(count, "part int, values binary, n binary"), parts).mapInPandas(add, "part int, weights binary")
    weights = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in rows.toLocalIterator():
        weights[edges[r.part]:edges[r.part + 1]] = np.frombuffer(r.weights, np.uint8)
    return weights


class Meeting:
    """Distinct (key, bucket, document) rows in order; groups of equal keys are large beyond few rows."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: np.ndarray, few: int):
        order = np.lexsort((docs, buckets, keys))
        keys, docs, buckets = keys[order], docs[order], buckets[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (buckets[1:] != buckets[:-1])
        self.keys, self.docs, self.buckets, self.few = keys[fresh], docs[fresh], buckets[fresh].astype(np.int64), few
        self.head = np.ones(len(self.keys), bool)
        self.head[1:] = self.keys[1:] != self.keys[:-1]
        starts = np.flatnonzero(self.head)
        size = np.diff(np.append(starts, len(self.keys)))
        self.start, self.large = np.repeat(starts, size), np.repeat(size > few, size)

    def ties(self) -> np.ndarray:
        """Distinct (document, least document) along the sizes of the large groups: rows that follow each other in a
        group by the same or the next bucket hang together."""
        cut = self.head.copy()
        cut[1:] |= self.buckets[1:] - self.buckets[:-1] > 1
        at = np.flatnonzero(cut)
        if not len(at):
            return np.zeros((0, 2), np.int64)
        least = np.repeat(np.minimum.reduceat(self.docs, at), np.diff(np.append(at, len(cut))))
        other = self.large & (self.docs != least)
        return np.unique(np.stack([self.docs[other], least[other]], axis=1), axis=0)

    def to_send(self) -> np.ndarray:
        """Rows that other tasks have to see: all of the small groups, and of a large one, whose rows are tied
        already, enough to be large wherever it arrives and one of each bucket."""
        lead = self.head.copy()
        lead[1:] |= self.buckets[1:] != self.buckets[:-1]
        return lead | (np.arange(len(self.keys)) - self.start <= self.few)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (later, earlier) pairs of the small groups, their smaller bucket, and in how many groups they meet."""
        found = [np.zeros((0, 3), np.int64)]
        for step in range(1, self.few):
            at = np.flatnonzero((self.start[step:] == self.start[:-step]) & ~self.large[step:]
                                & (self.buckets[step:] - self.buckets[:-step] <= 1) & (self.docs[step:] != self.docs[:-step]))
            x, y = self.docs[at + step], self.docs[at]
            found.append(np.stack([np.maximum(x, y), np.minimum(x, y), self.buckets[at]], axis=1))
        some, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return some[:, :2], some[:, 2], n


def shapes(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of each set."""
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in K.slices(texts):
                grams, cut = K.word_shingles(*K.buffer(texts[a:b]), words)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b], "n_shingles": np.diff(cut),
                                    "h1": K.segment_sums(K.mix(grams), cut).view(np.int64),
                                    "h2": K.segment_sums(K.mix(grams ^ np.uint64(0xABCDEF987654321)), cut).view(np.int64)})
    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, n_shingles long, h1 long, h2 long")


def candidates(documents: DataFrame, words: int, sizes: Sizes, weights: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b) of documents of similar size: those that share a segment are connected. If weights are given, so
    are those that meet in a shingle with more than FEW, and pairs that meet so often as their prefixes ask for.

    Tasks tie their own large groups first, so a key reaches its partition a few times from each; keys and pairs
    travel as packed arrays, and a pair is a row only once its meetings in all partitions are added up.
    """
    parts = partitions(documents.sparkSession)
    order_by = None if weights is None else documents.sparkSession.sparkContext.broadcast(weights)
    few = 1 if weights is None else FEW

    def keys_of(texts):
        grams, cut = K.word_shingles(*K.buffer(texts), words)
        keys, owner = segment_keys(grams, cut, sizes) if order_by is None else prefix_keys(grams, cut, sizes, order_by.value)
        return keys, owner, sizes.bucket(np.maximum(np.diff(cut), 1)).astype(np.uint8)[owner]

    def send(held: list):
        m = Meeting(*(np.concatenate(x) for x in zip(*held)), few)
        edges, go = m.ties(), m.to_send()
        return deal((m.keys[go] % np.uint64(parts)).astype(np.int64), parts, MEETING,
                    {"key": m.keys[go], "doc": m.docs[go], "bucket": m.buckets[go]}, {"tied": (edges[:, 0]), "to": (edges[:, 1])})

    def cut_up(batches):
        held, total = [], 0
        for pdf in batches:
            pdf = pdf[pdf["doc_id"].notna()]
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            for a, b in K.slices(texts):
                keys, owner, bucket = keys_of(texts[a:b])
                held.append((keys, ids[a:b][owner], bucket))
                total += len(keys)
                if total > FLUSH:
                    yield send(held)
                    held, total = [], 0
        if total:
            yield send(held)

    def meet(batches):
        x = gather(batches, MEETING)
        m = Meeting(x["key"], x["doc"], x["bucket"], few)
        edges = np.unique(np.concatenate([m.ties(), np.stack([x["tied"], x["to"]], axis=1)]), axis=0)
        some, bucket, n = m.pairs()
        a, b = (np.append(edges[:, k], some[:, k]) for k in (0, 1))
        to = K.mix(K.mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(parts)
        yield deal(to.astype(np.int64), parts, PAIRS, {"a": a, "b": b, "bucket": np.append(np.zeros(len(edges), np.int64), bucket),
                                                       "n": np.append(np.full(len(edges), ENOUGH), n)})

    def add_up(batches):
        x = gather(batches, PAIRS)
        order = np.lexsort((x["b"], x["a"]))
        a, b = x["a"][order], x["b"][order]
        head = np.ones(len(a), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(head)
        if len(at):
            n = np.add.reduceat(x["n"][order].astype(np.int64), at)
            size = sizes.bounds[np.minimum.reduceat(x["bucket"][order], at).astype(np.int64)]
            at = at[n >= np.maximum(1, size // SHARED)]
        yield pd.DataFrame({"a": a[at], "b": b[at]})

    packed = by_part(map_frames(documents.select("doc_id", "text"), cut_up, schema(MEETING)), parts)
    return by_part(packed.mapInPandas(meet, schema(PAIRS)), parts).mapInPandas(add_up, "a long, b long")


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]
        self.members: dict[int, np.ndarray] = {}

    def union(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


class SignatureTree:
    """Leaves in the order of their least hashes (similar sets are near each other), FAN children a node."""

    def __init__(self, grams: np.ndarray, cut: np.ndarray):
        n = np.diff(cut)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(n))), 8, 14))
        leaf = np.zeros((len(n), bits), bool)
        leaf[K.doc_of(cut), (K.mix(grams) % np.uint64(bits)).astype(np.int64)] = True
        packed = np.packbits(leaf, axis=1).view(np.uint64)
        slack = n - leaf.sum(axis=1)  # shingles that share their bit with another of the set
        self.levels = [(packed, n, n, slack)]
        while len(packed) > 1:
            heads = np.arange(0, len(packed), FAN)
            b, low, high, s = self.levels[-1]
            packed = np.bitwise_or.reduceat(b, heads, axis=0)
            self.levels.append((packed, np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(s, heads)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, sizes: Sizes) -> np.ndarray:
        """Whether sets below nodes i and j can be similar: their largest overlap against the least needed."""
        packed, low, high, slack = self.levels[level]
        need = sizes.least_overlap(low[i], low[j])
        most = np.minimum(high[i], high[j])
        ok = (most >= need) & (100 * most >= sizes.percent * np.maximum(low[i], low[j]))
        i, j = i[ok], j[ok]
        shared = np.bitwise_count(packed[i] & packed[j]).sum(axis=1, dtype=np.int64)
        ok[ok] = np.minimum(shared + np.minimum(slack[i], slack[j]), most[ok]) >= need[ok]
        return ok


def block_links(grams: np.ndarray, cut: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: Sizes) -> list[tuple[int, int]]:
    """Links (pairs of ids) that connect the block's sets as all their links do, given what labels connect."""
    n = np.diff(cut)
    heads = grams[cut[:-1]]
    order = np.lexsort((n, heads))
    sets = [grams[cut[k]:cut[k + 1]] for k in order]
    ids, forest, found = ids[order], Forest(labels[order]), []

    def verify(a: int, b: int) -> None:
        if forest.label[a] == forest.label[b]:
            return
        x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        if 100 * len(x) < sizes.percent * len(y):
            return
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        if int((y[at] == x).sum()) >= sizes.least_overlap(len(x), len(y)):
            forest.union(a, b)
            found.append((int(ids[a]), int(ids[b])))

    for a in range(len(sets) - 1):
        verify(a, a + 1)
    if len(sets) < 3 or (forest.label == forest.label[0]).all():
        return found
    size = np.array([len(s) for s in sets])
    tree = SignatureTree(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 20_000:
            stack += [(level, i[x:x + 20_000], j[x:x + 20_000]) for x in range(0, len(i), 20_000)]
            continue
        span = FAN ** level
        starts = np.arange(0, len(sets), span)
        low, high = np.minimum.reduceat(forest.label, starts), np.maximum.reduceat(forest.label, starts)
        apart = (np.minimum(low[i], low[j]) != np.maximum(high[i], high[j])) & ((level > 0) | (i != j))
        i, j = i[apart], j[apart]
        ok = tree.possible(level, i, j, sizes)
        i, j = i[ok], j[ok]
        if level == 0:
            for a, b in zip(i.tolist(), j.tolist()):
                verify(a, b)
            continue
        x, y = np.divmod(np.arange(FAN * FAN), FAN)
        i, j = (i[:, None] * FAN + x).ravel(), (j[:, None] * FAN + y).ravel()
        inside = (i <= j) & (j < len(tree.levels[level - 1][0]))
        if inside.any():
            stack.append((level - 1, i[inside], j[inside]))
    return found


def _solve(placed: DataFrame, words: int, sizes: Sizes) -> DataFrame:
    """Links of all blocks: rows (cid, block, node, label, text) come together by block."""
    def run(batches):
        held: list = []  # (grams, id, label) of the block that is being read
        now = None

        def solved():
            if len(held) < 2:
                return []
            grams = np.concatenate([h[0] for h in held])
            cut = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])])
            ids, labels = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            return block_links(grams, cut, ids, labels, sizes)

        for pdf in batches:
            links, texts = [], pdf["text"].tolist()
            where = list(zip(pdf["cid"].tolist(), pdf["block"].tolist()))
            for a, b in K.slices(texts):
                grams, cut = K.word_shingles(*K.buffer(texts[a:b]), words)
                for k in range(a, b):
                    if where[k] != now:
                        links += solved()
                        held, now = [], where[k]
                    some = grams[cut[k - a]:cut[k - a + 1]]
                    if len(some):
                        held.append((some.copy(), pdf["node"].iat[k], pdf["label"].iat[k]))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(solved(), columns=["a", "b"], dtype=np.int64)

    parts = partitions(placed.sparkSession)
    return placed.repartition(parts, "cid", "block").sortWithinPartitions("cid", "block").select(
        "cid", "block", "node", "label", "text").mapInPandas(run, "a long, b long")


def _ship(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Texts to the blocks of their node."""
    texts = documents.select(F.col("doc_id").alias("node"), "text")
    return texts.join(small(places.groupBy("node", "cid", "label").agg(F.collect_list("block").alias("blocks"))), "node").select(
        "cid", F.explode("blocks").alias("block"), "node", "label", "text")


def similar_groups(documents: DataFrame, words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES,
                   segments: bool | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach) and class_id (least doc_id
    with the same set). segments: route by segments or by rare shingles; by default as the similarity allows."""
    sizes = Sizes(percent)
    shape = Table(shapes(documents, words))
    full = shape.df.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["h1", "h2", "n_shingles"]
    classes = Table(full.groupBy(*key).agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).where("node < last").drop("last"))
    member = Table(spread_join(full, classes.df, key).select("doc_id", F.coalesce("node", "doc_id").alias("node"), "n_shingles").distinct())
    classes.drop()
    # rows of one id with different texts tie their classes together
    same_id = member.df.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("a", "b")

    weights = None
    if segments is False or segments is None and 100 + percent < 2 * WIDE * (100 - percent):
        weights = frequencies(documents, words)
    edges = candidates(documents, words, sizes, weights)
    for c in ("a", "b"):
        edges = edges.join(member.df.select(F.col("doc_id").alias(c), F.col("node").alias(f"node_{c}")), c)
    near = components(edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    sized = near.df.join(member.df.select("node", "n_shingles").distinct(), "node")
    total = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n"))
    place = Table(sized.join(total, "component").select(
        F.col("component").alias("cid"), "node", "n_shingles", "n",
        F.ceil(F.col("total") / F.lit(block_shingles)).alias("blocks")))
    own = place.df.select("node", "cid", F.lit(0).cast("long").alias("label"), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    hubs = place.df.where(F.col("blocks") > 1).where(
        F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.expr(f"n div {HUBS}"))) == 0).select(
        "node", "cid", F.lit(0).cast("long").alias("label"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    first = own.unionByName(hubs).distinct().withColumn("label", F.col("node"))
    links = Table(_solve(_ship(documents, first), words, sizes))
    found = components(links.df.unionByName(same_id))

    spread = place.df.where("blocks > 1")
    if not spread.isEmpty():
        more = Table(_solve(_ship(documents, _apart(spread, found.df, block_shingles)), words, sizes))
        both = links.df.unionByName(more.df).unionByName(same_id)
        found.drop()
        found = components(both)
        more.drop()
    links.drop()
    place.drop()
    near.drop()
    result = member.df.join(found.df, "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("c"), F.min("node").alias("class_id"))
    return shape.df.join(result, "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"))


def _apart(spread: DataFrame, found: DataFrame, block_shingles: int) -> DataFrame:
    """Blocks that bring together all members of a candidate component that are not connected yet.

    The members of the largest part meet those of the others; the others also meet each other.
    """
    now = spread.join(found, "node", "left").select("cid", "node", "n_shingles", F.coalesce("component", "node").alias("label"))
    parts = now.groupBy("cid", "label").agg(F.sum("n_shingles").alias("v"))
    lead = parts.groupBy("cid").agg(F.max(F.struct("v", "label")).alias("lead"), F.sum("v").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    size = lambda v: F.greatest(F.lit(1), F.ceil(v / F.lit(block_shingles))).cast("long")
    lead = lead.select("cid", F.col("lead.label").alias("main"), size(F.col("lead.v")).alias("mains"),
                       size(F.col("total") - F.col("lead.v")).alias("others"))
    now = now.join(lead, "cid").withColumn("is_main", F.col("label") == F.col("main"))
    now = now.withColumn("k", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    # blocks are numbered: (other, main) pairs first, then (other, other) pairs in a square of which a half is used
    zero = F.lit(0).cast("long")
    mains = F.transform(F.sequence(zero, F.col("others") - 1), lambda o: o * F.col("mains") + F.col("k"))
    others = F.concat(
        F.transform(F.sequence(zero, F.col("mains") - 1), lambda m: F.col("k") * F.col("mains") + m),
        F.transform(F.sequence(zero, F.col("others") - 1), lambda o: F.col("others") * F.col("mains")
                    + F.least(o, F.col("k")) * F.col("others") + F.greatest(o, F.col("k"))))
    return now.select("cid", "node", "label", F.explode(F.when(F.col("is_main"), mains).otherwise(others)).alias("block"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, without those similar to one with a smaller id (by links, through
    any number of them). Rows of one id and different texts are documents of their own, of which the one with the
    least hash of its text counts as smaller; of equal ids and texts one row stays. Documents without shingles or id
    all stay."""
    twice = Table(documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")))
    at = {c: f"c{i}" for i, c in enumerate(documents.columns)}  # columns by number, so that no name clashes
    if twice.df.isEmpty():
        twice.drop()
        groups = Table(similar_groups(documents.select("doc_id", "text"), words, percent).where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("gone")))
        rows = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in at.items()])
        return rows.join(small(groups.df), F.col(at["doc_id"]) == F.col("gone"), "left_anti").select(*[F.col(x).alias(c) for c, x in at.items()])
    # a repeated id and its text make a key of their own
    told = F.col("twice").isNotNull()
    rows = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in at.items()]).join(small(twice.df), F.col(at["doc_id"]) == F.col("twice"), "left").withColumn(
        "key", F.when(told, F.xxhash64(at["doc_id"], at["text"])).otherwise(F.col(at["doc_id"])))
    groups = Table(similar_groups(rows.select(F.col("key").alias("doc_id"), F.col(at["text"]).alias("text")), words, percent).where(
        "n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), "component_id").distinct())
    names = Table(rows.where(told).select("key", F.col(at["doc_id"]).alias("id")).distinct().join(groups.df.select("key"), "key", "left_semi"))
    # the least key of a component is its least id, unless keys stand for ids in it
    mixed = groups.df.join(small(names.df), "key", "left").groupBy("component_id").agg(
        F.max(F.col("id").isNotNull()).alias("m"), F.min(F.struct(F.coalesce("id", "key"), "key")).alias("first")).where("m").select("component_id", F.col("first.key").alias("stays"))
    gone = Table(groups.df.join(small(mixed), "component_id", "left").where(F.col("key") != F.coalesce("stays", "component_id")).select(F.col("key").alias("gone")))
    rows = rows.join(small(gone.df), F.col("key") == F.col("gone"), "left_anti").join(small(names.df.select(F.col("key").alias("full"))), F.col("key") == F.col("full"), "left")
    whole = F.struct(*at.values())
    first = rows.where("full IS NOT NULL").groupBy("key").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select(*[f"r.{x}" for x in at.values()])
    kept = rows.where("full IS NULL").select(*at.values()).unionByName(first)
    return kept.select(*[F.col(x).alias(c) for c, x in at.items()])
