"""Event journals and their windows.

A journal row has seq, ts (epoch seconds), sid, path, module, tags (array) and kind; rows with a kind are lifecycle
rows, the others tool rows.  Windows: ``Nc`` the last N tool rows, ``Ns/Nm/Nh/Nd`` wall clock (``ts + s >= now``, no
upper bound), ``s`` the current session.  All functions are pure in (journal, sid, now).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Rule

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
WINDOW = re.compile(r"(\d+)([csmhd])|s")
#: Predicates whose rules ask for windows, with the positions of selector, window and k.
ASKED = {"journey_occurrence": (0, 1, None), "journey_count": (0, 1, None), "journey_seen": (0, 1, None),
         "journey_since_ge": (0, None, 1), "journey_distinct": (0, 1, None), "journey_filtered_since_ge": (0, None, 2)}
#: Tail reads never go further back.
MOST_ROWS = 10_000


class WindowError(ValueError):
    """A window token or selector that means nothing."""


def parse_window(token: str) -> tuple[str, int]:
    """("calls", n), ("seconds", n) or ("session", 0)."""
    m = WINDOW.fullmatch(token)
    if not m:
        raise WindowError(f"unknown window {token!r}")
    if m[1] is None:
        return "session", 0
    n = int(m[1])
    return ("calls", n) if m[2] == "c" else ("seconds", n * UNITS[m[2]])


def selected(selector: str) -> Column:
    """Whether a row carries the tag, or lies in module:x."""
    hit = F.col("module") == selector[7:] if selector.startswith("module:") else F.array_contains("tags", selector)
    return F.coalesce(hit, F.lit(False))


def tools(journal: DataFrame) -> DataFrame:
    return journal.where("kind IS NULL")


def tail(journal: DataFrame, n: int) -> DataFrame:
    """The last rows, in order of seq."""
    return journal.orderBy(F.desc("seq")).limit(min(n, MOST_ROWS)).orderBy("seq")


def subject_tail(journal: DataFrame, subject: str, n: int) -> DataFrame:
    return tail(journal.where(F.col("subject") == subject), n)


def window(journal: DataFrame, token: str, sid: str, now: int) -> DataFrame:
    """The rows of a window; a window of calls is over tool rows only."""
    kind, n = parse_window(token)
    if kind == "calls":
        return tools(journal).orderBy(F.desc("seq")).limit(n)
    return journal.where(F.col("ts") + n >= now if kind == "seconds" else F.col("sid") == sid)


def occurrences(journal: DataFrame, selector: str, token: str, sid: str, now: int) -> DataFrame:
    return window(journal, token, sid, now).where(selected(selector)).select(F.lit(selector).alias("selector"), F.lit(token).alias("window"), "seq")


def counts(journal: DataFrame, asked: Iterable[tuple[str, str]], sid: str, now: int) -> DataFrame:
    """One row for each (selector, window), 0 included, from one pass for each kind of window."""
    asked = list(asked)
    plain = [(s, w) for s, w in asked if parse_window(w)[0] != "calls"]
    rows = []
    if plain:
        held = [F.count_if(selected(s) & (F.col("ts") + parse_window(w)[1] >= now if parse_window(w)[0] == "seconds" else F.col("sid") == sid)) for s, w in plain]
        one = journal.agg(F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(w).alias("window"), h.alias("n")) for (s, w), h in zip(plain, held)]).alias("r"))
        rows.append(one.select(F.inline("r")))
    for token in dict.fromkeys(w for _, w in asked if parse_window(w)[0] == "calls"):
        own = [s for s, w in asked if w == token]
        one = window(journal, token, sid, now).agg(F.array(*[
            F.struct(F.lit(s).alias("selector"), F.lit(token).alias("window"), F.count_if(selected(s)).alias("n")) for s in own]).alias("r"))
        rows.append(one.select(F.inline("r")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def many_counts(journal: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (selector, window, sid, now and others), each with n: the rows of its window that match its selector. Any
    number of questions is answered together: matches are counted up by selector along the time, and along the numbers of
    the tool rows, and a window's rows are all but those before its begin, which is one look into these counts. Counts of
    sessions are a join. A window token that means nothing is an error."""
    from ..plans.tables import cut, last_before, numbered, running

    token = F.col("window")
    size = F.regexp_extract(token, r"^(\d+)[csmhd]$", 1).try_cast("long")
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    seconds = size * F.try_element_at(unit, F.substring(token, -1, 1))
    asks = cut(asked.withColumns({"__ask": F.monotonically_increasing_id(), "__kind": F.when(token == "s", "session").when(size.isNull(), F.raise_error(F.concat(F.lit("unknown window "), token))).when(
        token.endswith("c"), "calls").otherwise("seconds"), "__size": size, "__back": seconds}))
    named = F.concat(F.col("tags"), F.when(F.col("module").isNotNull(), F.array(F.concat(F.lit("module:"), "module"))).otherwise(F.array()))
    each = F.explode(F.array_distinct(F.coalesce(named, F.when(F.col("module").isNotNull(), F.array(F.concat(F.lit("module:"), "module")))))).alias("__selector")
    wanted = asks.select(F.col("selector").alias("__selector")).distinct()
    hits = journal.select("seq", "ts", "sid", "kind", each).join(wanted, "__selector", "left_semi")
    calls = numbered(journal.where("kind IS NULL").select("seq"), "seq", "__at")
    last = calls.agg(F.coalesce(F.max("__at") + 1, F.lit(0)).alias("__calls"))  # one row
    along = hits.select("__selector", F.lit("seconds").alias("__kind"), F.col("ts").alias("__at")).unionByName(
        hits.where("kind IS NULL").join(calls, "seq").select("__selector", F.lit("calls").alias("__kind"), "__at"))
    upto = cut(running(along.groupBy("__selector", "__kind", "__at").agg(F.count("*").alias("__n")), ["__selector", "__kind"], "__at", "__n"))
    begin = F.when(F.col("__kind") == "calls", F.col("__calls") - F.col("__size")).otherwise(F.col("now") - F.col("__back"))
    looking = asks.where("__kind <> 'session'").crossJoin(F.broadcast(last)).select("__ask", F.col("selector").alias("__selector"), "__kind", begin.cast("long").alias("__at"), F.lit(0).alias("__turn"), F.lit(None).cast("long").alias("upto"))
    line = looking.unionByName(upto.select(F.lit(None).cast("long").alias("__ask"), "__selector", "__kind", F.col("__at").cast("long").alias("__at"), F.lit(1).alias("__turn"), "upto"))
    before = last_before(line, ["__selector", "__kind"], ["__at", "__turn"], {"__before": F.col("upto")}).where("__ask IS NOT NULL").select("__ask", F.coalesce("__before", F.lit(0)).alias("__before"))
    total = upto.select(F.col("__selector").alias("selector"), "__kind", "total").distinct()
    own = hits.groupBy(F.col("__selector").alias("selector"), "sid").agg(F.count("*").alias("__own")).withColumn("__kind", F.lit("session"))
    n = F.when(F.col("__kind") == "session", F.coalesce("__own", F.lit(0))).otherwise(F.coalesce(F.col("total") - F.col("__before"), F.lit(0)))
    return asks.join(before, "__ask", "left").join(total, ["selector", "__kind"], "left").join(own, ["selector", "__kind", "sid"], "left").select(*asked.columns, n.alias("n"))


def seen(journal: DataFrame, asked: Iterable[tuple[str, str]], sid: str, now: int) -> DataFrame:
    return counts(journal, asked, sid, now).where("n >= 1").select("selector", "window")


def ladder(rows: DataFrame, n: str, most: int) -> DataFrame:
    """A row for each k from 1 to the least of n and most."""
    top = F.least(F.col(n), F.lit(most))
    return rows.where(top >= 1).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), top.cast("long")))).drop(n)


def since(journal: DataFrame, selector: str, most: int) -> DataFrame:
    """k up to the number of tool rows after the last match among them; nothing if there was none."""
    rows = tools(journal)
    last = rows.where(selected(selector)).agg(F.max("seq").alias("last")).where("last IS NOT NULL")
    after = rows.join(F.broadcast(last), F.col("seq") > F.col("last")).agg(F.count("*").alias("n"))
    return ladder(after.select(F.lit(selector).alias("selector"), "n"), "n", most)


def filtered_since(journal: DataFrame, target: str, counted: str, most: int) -> DataFrame:
    """k up to the number of rows (of any kind) with the counted tag after the last target."""
    last = journal.where(selected(target)).agg(F.max("seq").alias("last")).where("last IS NOT NULL")
    after = journal.where(selected(counted)).join(F.broadcast(last), F.col("seq") > F.col("last")).agg(F.count("*").alias("n"))
    return ladder(after.select(F.lit(target).alias("target"), F.lit(counted).alias("counted"), "n"), "n", most)


def distinct_paths(journal: DataFrame, token: str, sid: str, now: int) -> DataFrame:
    """Distinct non-empty paths of the window's tool rows."""
    return window(tools(journal), token, sid, now).agg(F.count_distinct(F.when(F.col("path") != "", F.col("path"))).alias("n")).select(
        F.lit("path").alias("field"), F.lit(token).alias("window"), "n")


def specs(rules: Iterable[Rule]) -> dict[str, dict]:
    """What the rules ask for: by predicate, (selector, window) pairs or selectors with their largest k.

    A bad window is an error; a k that is no number is left out.
    """
    out: dict[str, dict] = {p: {} for p in ASKED}
    for rule in rules:
        for c in rule.conditions:
            if c.predicate not in ASKED or not c.args:
                continue
            s, w, k = ASKED[c.predicate]
            if w is not None and len(c.args) > w:
                parse_window(c.args[w])
                out[c.predicate].setdefault((c.args[s], c.args[w]), set()).add(rule.id)
            elif k is not None and len(c.args) > k and c.args[k].isdecimal():
                key = tuple(c.args[:k])
                out[c.predicate][key] = max(out[c.predicate].get(key, 0), int(c.args[k]))
    return out


def check_selectors(asked: Iterable[str], tags: Iterable[str], modules: Iterable[str], prefixes: Iterable[str] = ("lifecycle:", "kalpa:")) -> None:
    """An error for the first selector that no tagger, module or open prefix defines."""
    tags, modules = set(tags), set(modules)
    for s in asked:
        known = s[7:] in modules if s.startswith("module:") else s in tags or any(s.startswith(p) for p in prefixes)
        if not known:
            raise WindowError(f"selector {s!r} is not defined")


def facts(journal: DataFrame, rules: Iterable[Rule], sid: str, now: int) -> DataFrame:
    """All window facts (predicate, args) that the rules ask for."""
    asked = specs(rules)
    text = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    parts = []
    for s, w in asked["journey_occurrence"]:
        parts.append(occurrences(journal, s, w, sid, now).select(F.lit("journey_occurrence").alias("predicate"), text("selector", "window", "seq").alias("args")))
    if asked["journey_count"]:
        parts.append(counts(journal, asked["journey_count"], sid, now).select(F.lit("journey_count").alias("predicate"), text("selector", "window", "n").alias("args")))
    if asked["journey_seen"]:
        parts.append(seen(journal, asked["journey_seen"], sid, now).select(F.lit("journey_seen").alias("predicate"), text("selector", "window").alias("args")))
    for (s,), k in asked["journey_since_ge"].items():
        parts.append(since(journal, s, k).select(F.lit("journey_since_ge").alias("predicate"), text("selector", "k").alias("args")))
    for f, w in asked["journey_distinct"]:
        if f == "path":
            parts.append(distinct_paths(journal, w, sid, now).select(F.lit("journey_distinct").alias("predicate"), text("field", "window", "n").alias("args")))
    for (t, c), k in asked["journey_filtered_since_ge"].items():
        parts.append(filtered_since(journal, t, c, k).select(F.lit("journey_filtered_since_ge").alias("predicate"), text("target", "counted", "k").alias("args")))
    spark = journal.sparkSession
    out = spark.createDataFrame([], "predicate string, args array<string>")
    for p in parts:
        out = out.unionByName(p)
    return out


def compacted(journal: DataFrame, keep: int, subjects: int) -> DataFrame:
    """The last rows, all lifecycle rows, and the newest carrier of each (subject, signal tag) among the newest subjects."""
    last = journal.orderBy(F.desc("seq")).limit(keep).select("seq")
    alive = journal.where("subject IS NOT NULL").groupBy("subject").agg(F.max("seq").alias("s")).orderBy(F.desc("s")).limit(subjects).select("subject")
    signal = journal.where("subject IS NOT NULL").select("subject", "seq", F.explode("tags").alias("tag")).where("tag LIKE 'signal:%'").join(
        F.broadcast(alive), "subject").groupBy("subject", F.regexp_extract("tag", r"^signal:([^=]*)", 1)).agg(F.max("seq").alias("seq")).select("seq")
    kept = last.unionByName(signal).unionByName(journal.where("kind IS NOT NULL").select("seq")).distinct()
    return journal.join(kept, "seq", "left_semi")


def tagged(matches: DataFrame) -> DataFrame:
    """Sorted distinct tags of each row, from consequences (seq, action_type, message) of tagger rules."""
    return matches.where("action_type = 'tag'").groupBy("seq").agg(F.array_sort(F.collect_set("message")).alias("tags"))


def module_of(path: Column, modules: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The first module one of whose path patterns matches."""
    from ..functions.text import path_glob

    hits = [F.when(path_glob(path, p), F.lit(name)) for name, patterns in modules for p in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def paired_stops(events: DataFrame) -> DataFrame:
    """Stops with the start they end: with an agent id the latest open start of that id, else of any (last in, first
    out); start is null for a stop without one. Sequential by session, so sessions are folded one by one."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        open_, out = [], []
        for r in pdf.sort_values("seq").itertuples():
            if r.event == "start":
                open_.append((r.seq, r.agent))
            elif r.event == "stop":
                named = r.agent is not None and r.agent == r.agent
                at = next((i for i in range(len(open_) - 1, -1, -1) if not named or open_[i][1] == r.agent), None)
                out.append((r.sid, r.seq, open_.pop(at)[0] if at is not None else None))
        return pd.DataFrame(out, columns=["sid", "stop", "start"]).astype({"stop": "int64", "start": "Int64"})
    return events.select("sid", "seq", "event", "agent").groupBy("sid").applyInPandas(fold, "sid string, stop long, start long")


def prompt_class(events: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Prompts (event, agent, interrupted) classed by what went before in their session: fresh, correction or mid_turn. A
    session of any length is spread over tasks, since all that it hands on is its last event and its last turn event."""
    from ..plans.tables import GROUP_ROWS, last_before

    turn = F.when(F.col("event").isin("prompt", "stop", "session_end"), F.col("event"))
    marked = last_before(events, ["sid"], ["seq"], {"__last": F.col("event"), "__turn": turn}, group_rows or GROUP_ROWS)
    opened = F.coalesce(F.col("__turn") == "prompt", F.lit(False))
    return marked.where("event = 'prompt'").withColumn("mode", F.when(F.col("agent").isNotNull(), "fresh").when(
        F.col("__last") == "interrupt", "correction").when(~opened, "fresh").when(F.coalesce("interrupted", F.lit(False)), "correction").otherwise(
        "mid_turn")).drop("__last", "__turn")


def in_flight(events: DataFrame, now: int, ttl: int = 900) -> DataFrame:
    """Rows not older than the time to live."""
    return events.where(F.greatest(F.lit(now) - F.col("ts"), F.lit(0)) <= ttl)


def interruption(marked: Column, in_flight_since: Column, open_turn: Column, now: int, ttl: int = 900) -> Column:
    """What shows that a turn was interrupted, the strongest first: a mark in the transcript, a call that is still in
    flight, a turn that was never closed; null if nothing does."""
    live = F.lit(now) - in_flight_since
    return F.when(F.coalesce(marked, F.lit(False)), "transcript").when(F.coalesce((live >= 0) & (live <= ttl), F.lit(False)), "in_flight").when(F.coalesce(open_turn, F.lit(False)), "open_turn")


def commits(runs: DataFrame) -> DataFrame:
    """Runs (repo, seq, head, exit, command) after which the head differs, ended well, by a command that can move it."""
    before = F.lag("head").over(Window.partitionBy("repo").orderBy("seq"))
    moves = F.col("command").rlike(r"\bgit\b.*\b(commit|merge|rebase|cherry-pick|pull|am|revert)\b")
    return runs.withColumn("before", before).where((F.col("head") != F.col("before")) & (F.coalesce("exit", F.lit(0)) == 0) & moves)


def attribution(spark, rules: Iterable[Rule]) -> DataFrame:
    """(predicate, key, rules): which rules ask for each window fact; key holds the fact's leading arguments."""
    found: dict[tuple[str, str], set[str]] = {}
    for rule in rules:
        for c in rule.conditions:
            if c.predicate in ASKED and c.args:
                s, w, k = ASKED[c.predicate]
                found.setdefault((c.predicate, ",".join(c.args[:k if k is not None else (w or 0) + 1])), set()).add(rule.id)
    return spark.createDataFrame([(p, key, sorted(ids)) for (p, key), ids in sorted(found.items())], "predicate string, key string, rules array<string>")


def attributed(facts_: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Window facts (predicate, args) with the rules that ask for them."""
    from ..plans.tables import small

    by = attribution(facts_.sparkSession, rules)
    joined = F.array_join("args", ",")
    return facts_.join(small(by.withColumnRenamed("predicate", "__p")), (F.col("predicate") == F.col("__p")) & (
        (joined == F.col("key")) | F.startswith(joined, F.concat("key", F.lit(",")))), "left").drop("__p", "key")
