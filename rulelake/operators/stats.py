"""Reports over action logs: rule and lifecycle statistics, work items, metric families, trends, distributions.

A log has ts, kind, event and, where they apply, phase, tool, exit, subject, sid, kalpa, mode, duration_secs,
matched_start, confidence_band and consequences (array of rule_id, action_type).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_ranks

BLOCK, WARN = "constraint_violation", "constraint_warning"
#: Rest of a capped family.
OTHER = "__other__"


def since(log: DataFrame, now: int, secs: int | None) -> DataFrame:
    """Rows of the last secs (all if None); the bound never falls below 0."""
    return log if secs is None else log.where(F.col("ts") >= max(now - secs, 0))


def selected(log: DataFrame, now: int, secs: int | None = None, kind: str | None = None, event: str | None = None, failing: bool = False) -> DataFrame:
    """Rows of the last secs of this kind and event; failing: only those that ended with an exit other than 0."""
    rows = since(log, now, secs)
    for column, value in (("kind", kind), ("event", event)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.where(F.coalesce("exit", F.lit(0)) != 0) if failing else rows


def newest(log: DataFrame, limit: int, **equal) -> DataFrame:
    """The newest rows with these values."""
    for k, v in equal.items():
        log = log.where(F.col(k) == v)
    return log.orderBy(F.desc("ts")).limit(limit)


def rule_stats(log: DataFrame) -> DataFrame:
    """rule_id, blocked, warned, total, last ts; other actions do not count, rules without any are left out."""
    fired = log.select("ts", F.inline("consequences")).groupBy("rule_id").agg(
        F.count_if(F.col("action_type") == BLOCK).alias("blocked"), F.count_if(F.col("action_type") == WARN).alias("warned"),
        F.max(F.when(F.col("action_type").isin(BLOCK, WARN), F.col("ts"))).alias("last_ts"))
    return fired.withColumn("total", F.col("blocked") + F.col("warned")).where("total > 0").orderBy(F.desc("total"), "rule_id")


def integer_median(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Middle value, or the floored mean of both."""
    middle = at_ranks(rows, value, {"__lo": F.expr("(n + 1) div 2"), "__hi": F.expr("n div 2 + 1")}, by)
    return middle.select(*by, F.expr("(__lo + __hi) div 2").alias("median"))


def lifecycle(log: DataFrame, kalpa: str | None = None) -> DataFrame:
    """One row: events, prompts by mode, sessions, interventions, commits, bands, median duration and ratios."""
    rows = log.where("kind = 'lifecycle'")
    rows = rows if kalpa is None else rows.where(F.col("kalpa") == kalpa)
    event, mode, band = F.col("event"), F.col("mode"), F.col("confidence_band")
    marker = F.coalesce(event.startswith("kalpa"), F.lit(False))
    one = rows.agg(
        F.count("*").alias("events"), F.count_distinct(F.when(~marker, F.col("sid"))).alias("sessions"),
        F.count_if(event == "prompt").alias("prompts"), F.count_if((event == "prompt") & (mode == "correction")).alias("corrections"),
        F.count_if((event == "prompt") & (mode == "mid_turn")).alias("mid_turn"), F.count_if(event == "interrupt").alias("interrupts"),
        F.count_if(event == "commit").alias("commits"), F.count_if((event == "commit") & (band == "high")).alias("band_high"),
        F.count_if((event == "commit") & (band == "medium")).alias("band_medium"), F.count_if((event == "commit") & (band == "low")).alias("band_low"))
    middle = integer_median(rows.where("event = 'stop' AND matched_start"), "duration_secs").agg(F.max("median").alias("median_secs"))
    interventions = F.col("corrections") + F.col("mid_turn") + F.col("interrupts")
    return one.crossJoin(middle).withColumns({"interventions": interventions, "per_commit": F.try_divide(interventions, F.col("commits"))})


def by_event(log: DataFrame) -> DataFrame:
    return log.where("kind = 'lifecycle'").groupBy("event").agg(F.count("*").alias("n")).orderBy("event")


def work_items(log: DataFrame) -> DataFrame:
    """One row: explicit, implicit, completed and governed work items (completed, evaluated, last band not low)."""
    item = log.where("subject IS NOT NULL").groupBy("subject").agg(
        F.bool_or(F.col("event") == "work_start").alias("explicit"), F.bool_or(F.col("event") == "commit").alias("completed"),
        F.bool_or(F.col("kind") == "check").alias("evaluated"),
        F.max_by("confidence_band", F.when(F.col("confidence_band").isNotNull(), F.col("ts"))).alias("band"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return item.agg(F.count_if(flag("explicit")).alias("explicit"), F.count_if(~flag("explicit")).alias("implicit"), F.count_if(flag("completed")).alias("completed"),
                    F.count_if(flag("completed") & flag("evaluated") & ~F.col("band").eqNullSafe(F.lit("low"))).alias("governed"))


def decision_of(exit_code: Column, consequences: Column) -> Column:
    warned = F.exists(consequences, lambda c: c["action_type"] == WARN)
    return F.when(F.coalesce(exit_code, F.lit(0)) != 0, "block").when(F.coalesce(warned, F.lit(False)), "warn").otherwise("allow")


def hook_checks(log: DataFrame) -> DataFrame:
    return log.where("kind = 'check'").groupBy("phase", "tool", decision_of(F.col("exit"), F.col("consequences")).alias("decision")).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Sums by key; all beyond the largest so many (ties by key) in one row."""
    total = rows.groupBy(key).agg(F.sum(value).alias(value))
    top = total.orderBy(F.desc(value), key).limit(most).select(key, F.lit(True).alias("top"))
    name = F.when(F.col("top"), F.col(key)).otherwise(F.lit(OTHER))
    return total.join(F.broadcast(top), key, "left").groupBy(name.alias(key)).agg(F.sum(value).alias(value))


def histogram(rows: DataFrame, value: str, base: float = 1.0, buckets: int = 13, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts for the bounds base * 2**k and +Inf."""
    bounds = [base * 2 ** k for k in range(buckets)]
    one = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds], F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("n"))).alias("b"))
    return one.select(*by, F.inline("b"))


def sums(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(value).alias(value), F.count("*").alias("n"))


def exposition(rows: DataFrame, family: str, labels: Sequence[str], value: str) -> DataFrame:
    """Metric rows as exposition lines, sorted."""
    quoted = [F.concat(F.lit(f'{k}="'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"')) for k in labels]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}")) if labels else F.lit("")
    return rows.select(F.concat(F.lit(family), inside, F.lit(" "), F.col(value).cast("string")).alias("line")).orderBy("line")


def trend(snapshots: DataFrame) -> DataFrame:
    """snapshots (snapshot, rule_id, hits): first and last hits that are known, and the change; improvements first."""
    known = F.when(F.col("hits").isNotNull(), F.col("snapshot"))
    rows = snapshots.groupBy("rule_id").agg(F.min_by("hits", known).alias("first_hits"), F.max_by("hits", known).alias("last_hits"),
                                            F.count("hits").alias("known"))
    return rows.where("known > 0").withColumn("net", F.col("last_hits") - F.col("first_hits")).orderBy("net", "rule_id")


def filled(snapshots: DataFrame, ids: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for every snapshot and rule; hits is null where a rule was not measured."""
    from ..plans.tables import small

    return ids.select("snapshot").distinct().crossJoin(small(rules.select("rule_id").distinct())).join(snapshots, ["snapshot", "rule_id"], "left")


def nearest_rank(rows: DataFrame, value: str, levels: Sequence[int] = (50, 95), by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of whole numbers by nearest rank; 0 without rows."""
    ranks = {f"p{p}": F.greatest(F.lit(1), F.expr(f"(n * {p} + 99) div 100")) for p in levels}
    found = at_ranks(rows, value, ranks, by)
    if by:  # groups whose values are all missing
        every = rows.select(*by).distinct()
        found = every.join(found, [every[c].eqNullSafe(found[c]) for c in by], "left").select(*[every[c] for c in by], *[found[p] for p in ranks])
    return found.select(*by, *[F.coalesce(p, F.lit(0)).alias(p) for p in ranks])


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """n, floored mean, p50 and p95; a missing value counts as 0."""
    v = rows.select(F.coalesce(F.col(value), F.lit(0)).cast("long").alias("v"))
    whole = v.agg(F.count("*").alias("n"), F.coalesce(F.expr("sum(v) div count(*)"), F.lit(0)).alias("mean"))
    return whole.crossJoin(F.broadcast(nearest_rank(v, "v"))).select("n", "mean", "p50", "p95")


def tallies(rows: DataFrame, column: str) -> DataFrame:
    """Totals of a map column (kind to number) or counts of an array column's items."""
    kind = dict(rows.dtypes)[column]
    if kind.startswith("map"):
        return rows.select(F.explode(column).alias("item", "n")).groupBy("item").agg(F.sum("n").alias("n"))
    return rows.select(F.explode(column).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def unit_report(log: DataFrame, signals: DataFrame) -> DataFrame:
    """Work items: evaluated, fired, blocked (exit 2), warned (exit 1), and the tags that their journal rows carry."""
    one = log.where("subject IS NOT NULL").groupBy("subject").agg(
        F.count_if(F.col("kind") == "check").alias("evaluated"), F.sum(F.coalesce(F.size("consequences"), F.lit(0))).alias("fired"),
        F.count_if(F.col("exit") == 2).alias("blocked"), F.count_if(F.col("exit") == 1).alias("warned"))
    tags = signals.where("subject IS NOT NULL").select("subject", F.explode("tags").alias("t")).groupBy("subject").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    return one.join(tags, "subject", "left")


def kalpa_report(log: DataFrame, kalpa: str) -> DataFrame:
    """lifecycle() of one theme, and whether its start is still in the log."""
    start = log.agg(F.coalesce(F.bool_or((F.col("kalpa") == kalpa) & (F.col("event") == "kalpa_start")), F.lit(False)).alias("start_retained"))
    return lifecycle(log, kalpa).crossJoin(start)


def activity(items: DataFrame, limit: int) -> DataFrame:
    """items (rule_id, file, ts, severity, is_newest): the newest event's first, then block before warn before the rest."""
    rank = F.when(F.col("severity") == "block", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return items.orderBy(F.desc("is_newest"), rank, F.desc("ts"), "rule_id", "file").limit(limit)
