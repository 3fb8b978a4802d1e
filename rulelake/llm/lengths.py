"""Exact length histogram: documents by encoded length, and what any context limit gets from suffix sums.

Documents are counted by length where they are read; only (length, count) pairs are shuffled.  Suffix sums run in
two levels, over length ranges and inside each, so no task holds more than a range of the histogram.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .packing import encoder
from .storage import Table

RANGE = 1024


def histogram(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, n_docs."""
    path = vocabulary or tokens.vocabulary()

    def run(batches):
        seen: dict[int, int] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in K.slices(texts):
                for n, k in zip(*(x.tolist() for x in np.unique(encoder(path).counts(texts[a:b]), return_counts=True))):
                    seen[n] = seen.get(n, 0) + k
        yield pd.DataFrame({"length": list(seen), "n_docs": list(seen.values())}, dtype=np.int64)
    counted = documents.select("text").mapInPandas(run, "length long, n_docs long")
    return Table(counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))).df  # texts are encoded once, however often it is read


def suffix_sums(hist: DataFrame, span: int = RANGE) -> DataFrame:
    """Per length: documents and tokens at least so long, documents at most so long, and the tokens kept and lost
    if every document is cut at this length."""
    h = hist.withColumn("part", F.expr(f"length div {span}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    after = Window.partitionBy("all").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"), F.lit(0).alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                         F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                         F.sum("d").over(Window.partitionBy("all")).alias("docs"), F.sum("t").over(Window.partitionBy("all")).alias("all_tokens"))
    inside = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(parts, "part").withColumns({
        "docs_at_least": F.sum("n_docs").over(inside) + F.col("d_after"),
        "tokens_at_least": F.sum("tokens").over(inside) + F.col("t_after")})
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return out.select("length", "n_docs", "docs_at_least", "tokens_at_least",
                      (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
                      kept.alias("tokens_if_cut_here"), (F.col("all_tokens") - kept).alias("tokens_lost"))


def quantiles(sums: DataFrame, levels: list[float]) -> DataFrame:
    """Nearest-rank quantiles of the length: the smallest length that level of the documents do not exceed."""
    total = F.expr("docs_at_least + docs_at_most - n_docs")
    return sums.select("length", "docs_at_most", total.alias("docs"), F.explode(F.array(*map(F.lit, levels))).alias("level")).where(
        F.col("docs_at_most") >= F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("docs")))).groupBy("level").agg(F.min("length").alias("length"))


def limits(sums: DataFrame, at: list[int]) -> DataFrame:
    """Per context limit: documents longer than it, and the tokens that remain if every document is cut there."""
    longer = F.col("length") > F.col("max_tokens")
    total = F.expr("tokens_if_cut_here + tokens_lost")
    near = F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(longer, F.col("length")))
    found = sums.withColumn("max_tokens", F.explode(F.array(*map(F.lit, at)))).groupBy("max_tokens").agg(near.alias("s"), F.max(total).alias("total"))
    docs, toks = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    return found.select("max_tokens", docs.alias("docs_cut"), (F.col("total") - toks + F.col("max_tokens") * docs).alias("tokens_kept"))
