"""Importance resampling toward a target distribution, on hashed runs of words.

One scan per document keeps the running zlib states (CRC-32) of the last ``n`` starts in a ring; every word extends each
of them by a space and itself and begins a new one, so each run of 1 to ``n`` words costs one call over its last word.
The scan emits a bucket for every run.  Buckets are written once, as packed arrays, beside their documents; counts of
documents and target are sums over them, and a document's weight is the sum of its buckets' gains.

Documents are drawn by weight plus seeded Gumbel noise: the highest of these are a draw without replacement in
proportion to exp(weight).  Their exact ranks come from ranges of scores and counts of each range; no task orders all.

Defined results: null and empty texts have no words, no features and weight 0; repeated rows are scored each, and of
equal scores and ids the lesser weight, then the fewer features, rank first; a null doc_id draws its noise as an empty
id and ranks before other ids of its score; other columns are not read; an empty table gives no rows; an empty target
gives all buckets their gain from the documents alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .frames import arrow_schema, record
from .storage import Table, partitions

#: Runs of up to so many words, buckets, seed of the noise, least words of a drawn document, and the share drawn.
RUN, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: A-Z become a-z and all that is no word byte a blank.
FOLD = bytes(int(K.LOWER[b]) if K.PLAIN_WORD[b] else 32 for b in range(256))
#: Words of a document between two writes of the ring.
STRETCH = 1 << 16
_SCHEMA = "doc_id long, n_words long, buckets binary"


def ring(words: list[bytes], n: int, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """CRC-32 of all runs of 1..n consecutive words joined by one space, in stretches of words.

    states[k] is the running state of the start k words ago; what a stretch leaves of it goes on in the next one.
    """
    crc, states = zlib.crc32, [[] for _ in range(n)]
    for at in range(0, len(words), stretch):
        some = words[at:at + stretch]
        grown = [list(map(crc, some))]
        spaced = [b" " + w for w in some] if n > 1 else some
        for k in range(1, n):
            # word i extends the state that word i - 1 left; the first one extends what the last stretch left
            before = states[k - 1][-1:] + grown[k - 1][:-1]
            skip = len(some) - len(before)
            grown.append(list(map(crc, spaced[skip:], before)))
        states = grown
        yield np.concatenate([np.array(x, np.uint32) for x in grown])


def scanned(rows: DataFrame, id_column: str | None, n: int, buckets: int) -> DataFrame:
    """doc_id, n_words and the packed buckets of each text."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    schema = arrow_schema(_SCHEMA)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            for a, b in K.slices(texts):
                n_words, packed = [], []
                for text in texts[a:b]:
                    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
                    n_words.append(len(words))
                    packed.append(b"".join((crc % np.uint32(buckets)).astype(kind).tobytes() for crc in ring(words, n)))
                yield record(schema, {"doc_id": batch.column(0).slice(a, b - a), "n_words": n_words, "buckets": packed})
    ids = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")
    return rows.select(ids.alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a binary column without nulls, and the rows' offsets in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) // kind.itemsize
    data = column.buffers()[2]
    return (np.frombuffer(data, kind, offsets[-1]) if data else np.zeros(0, kind))[offsets[0]:], offsets - offsets[0]


def counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: each task sums its own, so it sends a row for each bucket at most."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_values(batch.column(0), kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for r in table.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Milli-nats that a feature of each bucket tells for the target."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(table: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    ddl = "doc_id long, n_words long, n_features long, weight long"
    schema = arrow_schema(ddl)
    kind = np.dtype("<u2") if len(gain) <= 1 << 16 else np.dtype("<u4")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, cut = _values(batch.column(2), kind)
            upto = np.zeros(len(values) + 1, np.int64)
            np.cumsum(gain[values], out=upto[1:])
            yield record(schema, {"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": np.diff(cut), "weight": np.diff(upto[cut])})
    return table.select("doc_id", "n_words", "buckets").mapInArrow(run, ddl)


def placed(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their place (from 1) in that order: ranges of rows are sorted on their own, and a range begins where
    the counts of those before it end."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a partition's rows are numbered from 0
    ranges = Table(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "inside": inside}))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.df.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # a row a range
    return ranges.df.join(F.broadcast(starts), "range").withColumn("place", F.col("base") + F.col("inside") + 1).drop("base", "inside", "range")


def resample(documents: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS,
             percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and, if it is drawn, its rank."""
    table = Table(scanned(documents, "doc_id", n, buckets))
    gain = gains(counts(table.df, buckets), counts(scanned(target, None, n, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = Table(weighed(table.df, gain, n).withColumn("score", F.col("weight") + noise))
    table.drop()
    enough = F.col("n_words") >= least_words
    drawn = scored.df.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")]
    columns = ["doc_id", "n_features", "weight", "score"]
    out = placed(scored.df.where(enough).select(*columns), order).select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return out.unionByName(scored.df.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


#: The query in SQL: CRC-32 of each distinct word by a table of 256 remainders.
SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM doc) GROUP BY ALL
), bw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL
), known AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM bw)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, t[1 + xor(c % 256, b)])), 4294967295) % 10000 AS bucket FROM known, crc
), s AS (SELECT bucket, sum(n) AS s FROM w JOIN hashed USING (word) GROUP BY ALL
), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (word) GROUP BY ALL
), total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), total
), weight AS (SELECT row, sum(n * gain) AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY ALL
), scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (row)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""
