"""Drift between notes, decisions, guidance and rules: best matches by word overlap, buckets, triage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, tokens

#: Below this similarity an entry is not covered.
COVERED = 0.15
#: Similarities (percent) above which a best match is looked for first.
STEPS = (50, 15)
#: What makes a text expressible as a rule. Commands with an argument, file shapes, function shapes.
COMMAND = r"\b(git|cargo|npm|pnpm|yarn|gh|make|rustup|rustfmt|clippy|docker|kubectl|pkill|killall)\s+(-{1,2}[\w][\w-]*|[a-z][a-z0-9_-]+)\b"
FILE = r"""\.[a-z]{1,5}\b[/\s,)'"]?|\b\w{2,}/\w{2,}|\bsrc/|\btests?/|\.\w+\(\)|\w+!\("""
FUNCTION = r"\b(fn|functions?|methods?)\b"
SHAPE = r"\b(param(eter)?s?|doc(s|umented|umentation)?|tests?|assert\w*|derive[sd]?|clones?|public|pub)\b"


def has_trigger(text: Column) -> Column:
    low = ascii_lower(text)
    return low.rlike(COMMAND) | low.rlike(FILE) | (low.rlike(FUNCTION) & low.rlike(SHAPE))


def best_match(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "target", text: str = "text", order: str = "ord", least: int = 0) -> DataFrame:
    """left ids with their most similar right id (Jaccard of word sets; the first by order on ties), the overlap and the
    union. Left texts without a shared word, or below the least similarity (percent), are left out.

    Words are ordered by how many right texts have them, rarest first. Two sets of some similarity share a word among the
    first of both, so many that no more are left than the others may lack; common words make no pairs then. The bound goes
    down in steps, and a left text that has found its best above one takes no part in the next. Right texts that have no
    more words in all than a broadcast may are counted whole along each left text instead, without pairs.
    """
    from ..plans.tables import BROADCAST_ROWS, Held, small

    b = right.select(F.col(right_id).alias("r"), F.col(order).alias("o"), tokens(F.col(text)).alias("t")).withColumn("rn", F.size("t"))
    a = left.select(F.col(left_id).alias("l"), tokens(F.col(text)).alias("t")).withColumn("ln", F.size("t"))
    words = b.select("r", "o", "rn", F.explode("t").alias("w"))
    if b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _best_of_few(a, b, least).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "shared", "union", "similarity")
    rarity = Held(words.groupBy("w").agg(F.count("*").alias("n")))
    rare = small(rarity.df)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"])
    index = Held(words.join(rare, "w").groupBy("r", "o", "rn").agg(ordered.alias("rw")))
    asked = Held(a.select("l", "ln", F.explode("t").alias("w")).join(rare, "w").groupBy("l", "ln").agg(ordered.alias("lw")))  # words that no right text has can't be shared
    found = None
    for percent in [x for x in STEPS if x > least] + [least]:
        rest = asked.df if found is None else asked.df.join(found.df.select("l"), "l", "left_anti")
        ahead = lambda n: n - F.floor((n * percent + 99) / 100) + 1  # noqa: B023,E731
        unknown = F.col("ln") - F.size("lw")  # these are the rarest of all
        mine = rest.select("l", "ln", F.explode(F.slice("lw", F.lit(1), F.greatest(F.lit(0), ahead(F.col("ln")) - unknown).cast("int"))).alias("w"))
        theirs = index.df.select("r", "rn", F.explode(F.slice("rw", F.lit(1), ahead(F.col("rn")).cast("int"))).alias("w"))
        near = (F.col("ln") * 100 >= F.col("rn") * percent) & (F.col("rn") * 100 >= F.col("ln") * percent)
        met = mine.join(small(theirs), "w").where(near).select("l", "r").distinct()
        shared = F.size(F.array_intersect("lw", "rw")).cast("long")
        scored = met.join(rest, "l").join(small(index.df), "r").withColumn("shared", shared).withColumn("union", F.col("ln") + F.col("rn") - F.col("shared")).where((F.col("shared") > 0) & (F.col("shared") * 100 >= F.col("union") * percent))
        # exact comparison of fractions is needed only to single precision, as the similarity is reported
        scored = scored.withColumn("similarity", (F.col("shared") / F.col("union")).cast("float"))
        best = scored.groupBy("l").agg(F.max_by(F.struct("r", "shared", "union", "similarity"), F.struct("similarity", (-F.col("o")).alias("o"))).alias("m")).select("l", "m.*")
        if found is None:
            found = Held(best)
        else:
            found.become(found.df.unionByName(best))
    for t in (rarity, index, asked):
        t.drop()
    return found.df.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "shared", "union", "similarity")


def _best_of_few(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """(l, r, shared, union, similarity): for left sets (l, t, ln), the best of right sets (r, o, t, rn) whose words fit a
    broadcast. Each task counts, by word, in which right sets a left set's words are."""
    told = b.where("rn > 0").orderBy(F.asc_nulls_last("o")).collect()  # within BROADCAST_ROWS; of equals the first is taken
    posting: dict[str, list[int]] = {}
    for i, r in enumerate(told):
        for w in r.t:
            posting.setdefault(w, []).append(i)
    spark = a.sparkSession
    shared = spark.sparkContext.broadcast(({w: np.array(v, np.int64) for w, v in posting.items()}, np.array([r.rn for r in told], np.int64)))

    def run(batches):
        for batch in batches:
            index, sizes = shared.value
            rows, best, common, union = [], [], [], []
            for at, (words, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                met = [index[w] for w in words or () if w in index]
                if not met:
                    continue
                count = np.bincount(np.concatenate(met), minlength=len(sizes))
                whole = n + sizes - count
                score = np.where((count > 0) & (count * 100 >= whole * least), count / whole, -1).astype(np.float32)  # single precision, as it is reported
                k = int(score.argmax())
                if score[k] >= 0:
                    for column, value in zip((rows, best, common, union), (at, k, count[k], whole[k])):
                        column.append(int(value))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(v, pa.int64()) for v in (best, common, union)]], ["l", "at", "shared", "union"])
    rights = spark.createDataFrame([(i, r.r) for i, r in enumerate(told)], f"at long, r {dict(b.dtypes)['r']}")
    found = a.select("l", "t", "ln").mapInArrow(run, f"l {dict(a.dtypes)['l']}, at long, shared long, union long")
    return found.join(F.broadcast(rights), "at").withColumn("similarity", (F.col("shared") / F.col("union")).cast("float"))


def bucket(kind: Column, text: Column) -> Column:
    """actionable, ambient or personal."""
    return F.when(kind.isin("feedback", "project"), F.when(has_trigger(text), "actionable").otherwise("ambient")).otherwise("personal")


def notes(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """entries (id, kind, description, body) with bucket, best match among targets (target, ord, text) and coverage."""
    text = F.concat_ws(" ", "description", "body")
    best = best_match(entries.select("id", text.alias("text")), targets)
    enough = F.coalesce("similarity", F.lit(0.0)) >= F.lit(COVERED).cast("float")
    return entries.select("id", bucket(F.col("kind"), text).alias("bucket")).join(best, "id", "left").withColumns({
        "covered": enough, "target": F.when(enough, F.col("target")), "similarity": F.coalesce("similarity", F.lit(0.0).cast("float"))})


def decisions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (id, status, enforces array, text): superseded ones go; a named rule that exists covers (1.0); else a
    similarity over the bound is likely; else uncovered with similarity 0."""
    alive = pages.where("status <> 'superseded'")
    named = alive.select("id", F.explode("enforces").alias("target")).join(rules.select("target"), "target").groupBy("id").agg(F.min("target").alias("named"))
    best = best_match(alive, rules, least=int(100 * COVERED) - 1)
    likely = F.col("similarity") >= F.lit(COVERED).cast("float")
    state = F.when(F.col("named").isNotNull(), "covered").when(likely, "likely").otherwise("uncovered")
    return alive.select("id").join(named, "id", "left").join(best, "id", "left").select(
        "id", state.alias("state"), F.coalesce("named", F.when(likely, F.col("target"))).alias("target"),
        F.when(F.col("named").isNotNull(), F.lit(1.0)).when(likely, F.col("similarity")).otherwise(F.lit(0.0)).cast("float").alias("similarity"))


def guidance(bullets: DataFrame, rules: DataFrame) -> DataFrame:
    """Imperatives with their best match, kept even below the bound."""
    return bullets.select("id").join(best_match(bullets, rules), "id", "left").withColumns({
        "similarity": F.coalesce("similarity", F.lit(0.0).cast("float")),
        "covered": F.coalesce(F.col("similarity") >= F.lit(COVERED).cast("float"), F.lit(False))})


def triage(items: DataFrame, limit: int) -> DataFrame:
    """items (family, personal, ord): family descending, personal ones last, then as given; with total and truncated."""
    n = max(1, min(limit, 50))
    total = items.agg(F.count("*").alias("total"))
    return items.orderBy(F.desc("family"), "personal", "ord").limit(n).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > n)


def totals(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items by family without personal ones, for every source; an unavailable source has null."""
    n = items.where(~F.col("personal")).groupBy("family").agg(F.count("*").alias("n"))
    return sources.join(n, "family", "left").withColumn("n", F.when(F.col("available"), F.coalesce("n", F.lit(0))))


def code(reconciled: DataFrame) -> DataFrame:
    """Bindings (see graph.reconcile) that no longer stand as they were: moved or stale symbols, with where they went."""
    return reconciled.where(F.col("state") != "bound").select(
        F.lit("code").alias("family"), "rule", "symbol", "state", F.array_join("relocated", ",").alias("now_at"))


def aggregate(spark: SparkSession, sources: dict[str, Callable[[], DataFrame | None]]) -> DataFrame:
    """One row a source with its state (ok, missing or error) and how many items it has; a source that is missing or fails
    stays in the report and does not stop the others."""
    rows = []
    for name, read in sources.items():
        try:
            items = read()
            rows.append((name, "missing", None, None) if items is None else (name, "ok", items.count(), None))
        except Exception as e:  # noqa: BLE001  the error is this source's state
            rows.append((name, "error", None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "source string, state string, n long, error string")
