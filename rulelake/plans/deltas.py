"""Activations kept up to date under changes of facts, by counted deltas.

A change log (id, predicate, args, timestamp, source, d, seq) asserts facts with d = 1 and retracts them by id with
d = -1; the last entry of an id decides.  What it changes is a signed table of facts.  The joins of a rule's conditions
turn it into a signed table of joined rows: the changes stand in each condition in turn, before them the conditions read
the old facts and after them the new ones, so that the signs of every combination add up to how often it came or went.

Guards hold or fail with facts of their own.  Rows that stay are looked at again only if a fact that changed is one that
some guard of theirs counts: those are found by the guard's own join, over the changed facts alone, and are evaluated
before and after.  All signs of an activation are added up; what is not zero is the delta.

The joined rows are the memory between changes; they, the facts and the delta are written to the shared folder, so a lost
executor rereads files.  Each change reads the memory, and joins only the changed facts with the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Rule, is_variable
from . import expressions, guards
from .rules import _patterns, activations, alpha, chained
from .tables import Held

FIELDS = ("id", "predicate", "args", "timestamp", "source")
#: What tells activations of one rule apart, for adding up their signs.
ACTIVATION = ("rule_id", "salience", "rule_ord", "fact_ids", "guard_error")


def signed(facts: DataFrame, log: DataFrame) -> DataFrame:
    """The facts that a change log takes away (d = -1) and brings (d = 1). A fact that is asserted as it is, and one that
    is retracted and not there, change nothing; one asserted with another content replaces the old one."""
    last = log.groupBy("id").agg(F.max_by(F.struct("d", *FIELDS[1:]), "seq").alias("l"))
    both = facts.select("id", F.struct(*FIELDS[1:]).alias("was")).join(last, "id", "right")
    same = F.col("was.predicate").eqNullSafe(F.col("l.predicate")) & F.col("was.args").eqNullSafe(F.col("l.args"))
    there, asked = F.col("was").isNotNull(), F.col("l.d") > 0
    gone = F.when(there & ~(asked & same), F.struct(F.lit(-1).alias("d"), *[F.col(f"was.{c}").alias(c) for c in FIELDS[1:]]))
    come = F.when(asked & ~(there & same), F.struct(F.lit(1).alias("d"), *[F.col(f"l.{c}").alias(c) for c in FIELDS[1:]]))
    return both.select("id", F.inline(F.array_compact(F.array(gone, come)))).select(*FIELDS, "d")


def _order(rule: Rule, first: int) -> list[int]:
    """Conditions from the first one on, each next to one that it shares a variable with, if there is one."""
    patterns = _patterns(rule)
    names = [{a for a in c.args if is_variable(a)} for c in patterns]
    out, bound = [first], set(names[first])
    while len(out) < len(patterns):
        rest = [i for i in range(len(patterns)) if i not in out]
        at = next((i for i in rest if names[i] & bound), rest[0])
        out.append(at)
        bound |= names[at]
    return out


def joined(facts: DataFrame, rule: Rule) -> DataFrame:
    """Rows in which all conditions hold, guards aside."""
    patterns = _patterns(rule)
    return _columns(chained([alpha(facts, c.predicate, c.args, n) for n, c in enumerate(patterns)], [c.predicate for c in patterns]), rule)


def _columns(rows: DataFrame, rule: Rule, *more: str) -> DataFrame:
    n = len(_patterns(rule))
    return rows.select(*[f"__id{i}" for i in range(n)], *[f"__src{i}" for i in range(n)], *[F.col(f"`{v}`") for v in sorted(rule.bound())], *more)


def joined_delta(old: DataFrame, new: DataFrame, changed: DataFrame, rule: Rule) -> DataFrame:
    """Signed rows of the conditions' join: __d is 1 for those that come and -1 for those that go."""
    out = []
    for at in range(len(_patterns(rule))):
        parts, order = [], _order(rule, at)
        for i in order:
            c = _patterns(rule)[i]
            parts.append(alpha(changed, c.predicate, c.args, i, ["d"]) if i == at else alpha(old if i < at else new, c.predicate, c.args, i))
        out.append(_columns(chained(parts, [_patterns(rule)[i].predicate for i in order]), rule, "d"))
    rows = reduce(DataFrame.unionByName, out)
    key = [F.col(f"`{c}`") for c in rows.columns if c != "d"]
    return rows.groupBy(*key).agg(F.sum("d").alias("__d")).where("__d <> 0")


def touched(rows: DataFrame, changed: DataFrame, rule: Rule) -> DataFrame:
    """Joined rows that have a guard which counts some changed fact."""
    out, bound = [], rule.bound()
    for script in (c.script for c in rule.conditions if c.script):
        guard = guards.parse(script)
        if guard:
            some = guards.Guard(False, guard.predicate, guard.args, guard.op and ">=", 1)
            out.append(guards.apply(rows, changed, some, bound))
            continue
        try:
            _, counts = expressions.compiled(script, bound)
        except expressions.Malformed:
            continue  # the same before and after
        if any(v.needs for n in counts for v in n.filters):  # a count inside a count may change with any fact
            out.append(rows)
            continue
        out += [expressions.counted(rows, changed, n).where(F.col(n.name) > 0).select(*[F.col(f"`{c}`") for c in rows.columns]) for n in counts]
    if not out:
        return rows.limit(0)
    return reduce(DataFrame.unionByName, out).dropDuplicates([c for c in rows.columns if c.startswith("__id")])


class Incremental:
    """One rule's activations over facts that change."""

    def __init__(self, facts: DataFrame, rule: Rule, ord: int = 0):
        if not _patterns(rule):
            raise ValueError(f"rule {rule.id} has no conditions over facts")
        self.rule, self.ord = rule, ord
        self.facts = Held(facts.select(*FIELDS))
        self.rows = Held(joined(self.facts.df, rule))
        self.delta: Held | None = None

    def _held(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        return activations(facts, self.rule, self.ord, rows, len(_patterns(self.rule))).select(*ACTIVATION, "bindings", "fact_sources")

    def agenda(self) -> DataFrame:
        """All activations that hold now."""
        return self._held(self.rows.df, self.facts.df)

    def change(self, log: DataFrame) -> DataFrame:
        """Applies a change log; gives the activations that hold now and did not (d = 1), and the other way round (d = -1)."""
        old = self.facts.df
        changed = Held(signed(old, log))
        gone, come = (changed.df.where(f"d = {d}").drop("d") for d in (-1, 1))
        new = Held(old.join(gone.select("id"), "id", "left_anti").select(*FIELDS).unionByName(come))
        moved = Held(joined_delta(old, new.df, changed.df, self.rule))
        plus, minus = (moved.df.where(f"__d = {d}").drop("__d") for d in (1, -1))
        ids = [c for c in self.rows.df.columns if c.startswith("__id")]
        stay = self.rows.df.join(minus.select(*ids), ids, "left_anti").select(*[F.col(f"`{c}`") for c in self.rows.df.columns])
        again = Held(touched(stay, changed.df.drop("d"), self.rule))
        parts = [(plus, new.df, 1), (minus, old, -1), (again.df, new.df, 1), (again.df, old, -1)]
        told = reduce(DataFrame.unionByName, [self._held(rows, facts).withColumn("d", F.lit(d)) for rows, facts, d in parts])
        values = F.array_sort(F.map_entries("bindings")).alias("__values")  # an id may come back with another content
        told = told.groupBy(*ACTIVATION, values).agg(F.any_value("bindings").alias("bindings"), F.any_value("fact_sources").alias("fact_sources"), F.sum("d").cast("int").alias("d")).where("d <> 0").drop("__values")
        delta = Held(told)
        self.rows.become(stay.unionByName(plus))
        for done in (self.facts, changed, moved, again, *([self.delta] if self.delta else [])):
            done.drop()
        self.facts, self.delta = new, delta
        return delta.df

    def drop(self) -> None:
        for t in (self.facts, self.rows, *([self.delta] if self.delta else [])):
            t.drop()
