"""Rules compiled to plans: each condition is a pushed-down filter, shared variables are equi-joins, guards are semi,
anti or count joins, actions are projections.  One DataFrame of facts goes in, one of consequences comes out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_string
from ..model import VARIABLE, Action, Condition, PolicyError, Rule, is_variable
from . import expressions, guards
from .tables import BROADCAST_ROWS, cut

AGENDA = ("rule_id", "salience", "rule_ord", "fact_ids", "bindings", "fact_sources", "guard_error")


def alpha(facts: DataFrame, predicate: str, args: Sequence[str], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """Facts that match a condition: predicate, exact arity, constants and repeated variables; columns are variables (and
    those of the facts that are to be kept)."""
    rows = facts.where((F.col("predicate") == predicate) & (F.size("args") == len(args)))
    first: dict[str, int] = {}
    for i, a in enumerate(args):
        if not is_variable(a):
            rows = rows.where(F.col("args")[i] == a)
        elif a in first:
            rows = rows.where(F.col("args")[i] == F.col("args")[first[a]])
        else:
            first[a] = i
    return rows.select(F.col("id").alias(f"__id{n}"), F.col("source").alias(f"__src{n}"), *[F.col("args")[i].alias(v) for v, i in first.items()], *keep)


#: Facts of one relation that agree in the variables of a join, beyond which the pairs they make are dealt out to several
#: tasks in blocks of so many; and the partitions that blocks are dealt out to at most.
PEERS, PEER_PARTITIONS = 500, 10_000


def beta(left: DataFrame, right: DataFrame, peers: bool = False) -> DataFrame:
    """Natural join on the shared variables; without any, every pair. peers: right is of a relation that left is of too,
    so a value that many facts share makes the square of them in pairs."""
    shared = [c for c in left.columns if c in right.columns and c.startswith("?")]
    if not shared:
        return left.crossJoin(right)
    if peers and not (left.isStreaming or right.isStreaming):
        return _peers(left, right, shared)
    return left.join(right, shared)


def _peers(left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
    """The join of facts with others of their relation. Few values leave Spark few tasks, whose work it takes to be as
    small as their rows: so right facts of a frequent value are dealt out to blocks by their ids, left rows meet every
    block, and a task gets blocks. A left row is copied once for every PEERS pairs it is in."""
    there = reduce(Column.__and__, [F.col(f"`{v}`").isNotNull() for v in shared])
    names = [F.col(f"`{v}`") for v in shared]
    frequent = cut(right.where(there).groupBy(*names).count().where(F.col("count") > PEERS).select(*names, F.ceil(F.col("count") / PEERS).cast("int").alias("__blocks")))
    values, blocks = frequent.agg(F.count("*"), F.sum("__blocks")).first()
    if not values:
        return left.join(right, shared)
    parts = min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 2 * blocks, PEER_PARTITIONS)
    known = F.broadcast(frequent) if values <= BROADCAST_ROWS else frequent
    of = F.coalesce("__blocks", F.lit(1))
    copied = left.where(there).repartition(parts).join(known, shared, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), of - 1)))
    ident = next(c for c in right.columns if c.startswith("__id"))
    dealt = right.where(there).join(known, shared, "left").withColumn("__block", F.pmod(F.xxhash64(ident), of).cast("int"))
    both = [rows.drop("__blocks").repartition(parts, *names, "__block") for rows in (copied, dealt)]
    return both[0].join(both[1].hint("merge"), [*shared, "__block"]).drop("__block")


def chained(parts: Sequence[DataFrame], predicates: Sequence[str]) -> DataFrame:
    """The join of conditions, each in turn with those before it. predicates: of all conditions, in the same order; the
    first part may stand for several."""
    skip = len(predicates) - len(parts)
    return reduce(lambda rows, i: beta(rows, parts[i], predicates[skip + i] in predicates[:skip + i]), range(1, len(parts)), parts[0])


def activations(facts: DataFrame, rule: Rule, ord: int = 0, start: DataFrame | None = None, done: int = 0) -> DataFrame:
    """One row for each way the rule's conditions hold. start: the join of its first conditions (so many), if there."""
    spark = facts.sparkSession
    patterns = [c for c in rule.conditions if c.predicate]
    scripts = [c.script for c in rule.conditions if c.script]
    parts = [*([] if start is None else [start]), *[alpha(facts, c.predicate, c.args, n) for n, c in enumerate(patterns) if n >= done]]
    rows = chained(parts, [c.predicate for c in patterns]) if parts else spark.range(1).select()
    bound = sorted(rule.bound())
    errors: list[Column] = []
    for script in scripts:
        guard = guards.parse(script)
        if guard:
            rows = guards.apply(rows, facts, guard, set(bound))
            continue
        name = f"__v{len(errors)}"
        try:
            rows = expressions.apply(rows, facts, script, set(bound), name).where(F.coalesce(F.col(name), F.lit(True)))
        except expressions.Malformed as e:
            errors.append(F.lit(f"guard: {e}"))
            continue
        errors.append(F.when(F.col(name).isNull(), F.lit("guard: no value")))
    ids = [F.col(f"__id{n}") for n in range(len(patterns))]
    sources = [F.struct(F.col(f"__id{n}").alias("key"), F.col(f"__src{n}").alias("value")) for n in range(len(patterns))]
    empty = F.array().cast("array<string>")
    known = F.map_from_entries(F.array_distinct(F.filter(F.array(*sources), lambda s: s["value"].isNotNull()))) if sources else F.map_from_arrays(empty, empty)
    return rows.select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.priority).alias("salience"), F.lit(ord).alias("rule_ord"),
        (F.array(*ids) if ids else empty).alias("fact_ids"), _map(bound).alias("bindings"), known.alias("fact_sources"),
        (F.coalesce(*errors) if errors else F.lit(None).cast("string")).alias("guard_error"), *[F.col(f"`{v}`") for v in bound])


def _map(bound: Sequence[str]) -> Column:
    empty = F.array().cast("array<string>")
    if not bound:
        return F.map_from_arrays(empty, empty)
    return F.create_map(*[x for v in bound for x in (F.lit(v), F.col(f"`{v}`"))])


def rendered(value, bound: dict[str, Column], key: str | None = None, only: str | None = None) -> Column:
    """JSON text of a value whose string leaves hold variables; only: the one top-level key in which they count."""
    if isinstance(value, str):
        return json_string(guards.template(value, bound if only is None or key == only else {}))
    if isinstance(value, dict):
        parts = [x for i, (k, v) in enumerate(sorted(value.items())) for x in (
            F.concat(F.lit("," if i else ""), json_string(F.lit(k)), F.lit(":")), rendered(v, bound, key or k, only))]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    if isinstance(value, list):
        parts = [x for i, v in enumerate(value) for x in (F.lit("," if i else ""), rendered(v, bound, key, only))]
        return F.concat(F.lit("["), *parts, F.lit("]"))
    import json

    return F.lit(json.dumps(value))


def consequence(rows: DataFrame, rule: Rule, number: int, action: Action) -> DataFrame:
    """What one action of a rule says for each activation."""
    bound = {v: F.col(f"`{v}`") for v in rule.bound()}
    params = F.array(*[guards.template(p, bound) for p in action.params]).cast("array<string>")
    loose = list(dict.fromkeys(v for t in action.texts() for v in VARIABLE.findall(t) if v not in bound))
    data = F.lit(None).cast("string") if action.data is None else rendered(action.data, bound, only="body" if action.action_type == "emit_capsule" else None)
    kind = "constraint" if action.action_type.startswith("constraint_") else "event"
    return rows.select(*AGENDA, F.lit(number).alias("action_ord"), F.lit(kind).alias("kind"), F.lit(action.action_type).alias("action_type"),
                       F.array_join(params, " ").alias("message"), params.alias("params"), data.alias("data"),
                       F.array(*map(F.lit, loose)).cast("array<string>").alias("unbound_variables"))


def shared(facts: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The facts that some condition or guard can match, written once in folders by predicate: every condition of every
    rule then reads its relation only, however many rules ask for it."""
    return cut(pruned(facts, rules), "predicate").select(*facts.columns)


def shared_activations(facts: DataFrame, rules: Sequence[Rule]) -> list[DataFrame]:
    """activations() of each rule with shared work: facts are scanned once, and a chain of conditions with which several
    rules begin (the same up to the names of variables) is joined once; each rule continues from the longest it shares."""
    memory = shared(facts, rules)
    chains: dict[tuple, int] = {}
    for r in rules:
        for k in range(2, len(_patterns(r)) + 1):
            chains[_chain(r, k)] = chains.get(_chain(r, k), 0) + 1
    joined: dict[tuple, DataFrame] = {}
    out = []
    for n, r in enumerate(rules):
        k = max((k for k in range(2, len(_patterns(r)) + 1) if chains[_chain(r, k)] > 1), default=0)
        start = None
        if k:
            names, key = _names(r, k), _chain(r, k)
            if key not in joined:
                rows = chained([alpha(memory, c.predicate, c.args, i) for i, c in enumerate(_patterns(r)[:k])], [c.predicate for c in _patterns(r)[:k]])
                joined[key] = cut(rows.withColumnsRenamed({v: f"v{i}" for v, i in names.items()}))
            start = joined[key].withColumnsRenamed({f"v{i}": v for v, i in names.items()})
        out.append(activations(memory, r, n, start, k))
    return out


def _patterns(rule: Rule) -> list[Condition]:
    return [c for c in rule.conditions if c.predicate]


def _names(rule: Rule, k: int) -> dict[str, int]:
    names: dict[str, int] = {}
    for c in _patterns(rule)[:k]:
        for a in c.args:
            if is_variable(a):
                names.setdefault(a, len(names))
    return names


def _chain(rule: Rule, k: int) -> tuple:
    names = _names(rule, k)
    return tuple((c.predicate, tuple(names.get(a, f"={a}") for a in c.args)) for c in _patterns(rule)[:k])


def delta_activations(before: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """Activations that hold with new facts and did not without: at least one condition is matched by a new fact. For each
    condition in turn the new facts stand there, the old ones before it and all after it, so none is found twice."""
    patterns, every = _patterns(rule), before.unionByName(new)
    out = []
    for at in range(len(patterns)):
        parts = [alpha(before if i < at else new if i == at else every, c.predicate, c.args, i) for i, c in enumerate(patterns)]
        rows = chained(parts, [c.predicate for c in patterns])
        out.append(activations(every, rule, 0, rows, len(patterns)))
    return reduce(DataFrame.unionByName, out)


def late(found: DataFrame, facts: DataFrame, added_at: int) -> DataFrame:
    """Of a rule's activations, those an incremental engine would hold if the rule was added at that time: all of their
    facts were asserted from then on."""
    old = facts.where(F.col("timestamp") < added_at).select(F.col("id").alias("__old"))
    early = found.select("fact_ids", F.explode("fact_ids").alias("__old")).join(old, "__old", "left_semi").select("fact_ids").distinct()
    return found.join(early, "fact_ids", "left_anti")


class Batch:
    """Assertions and retractions that take effect together, in order."""

    def __init__(self):
        self.steps: list[tuple[str, DataFrame]] = []

    def assert_facts(self, more: DataFrame) -> None:
        self.steps.append(("assert", more))

    def retract(self, ids: DataFrame) -> None:
        self.steps.append(("retract", ids))


class Session:
    """A snapshot of facts and a list of rules."""

    @contextmanager
    def batch(self):
        """A span of changes applied as one: runs of assertions are merged at once, runs of retractions are one join, and
        the result is written so that later plans start from it."""
        b = Batch()
        yield b
        for kind, group in groupby(b.steps, key=lambda s: s[0]):
            rows = [df for _, df in group]
            if kind == "assert":
                self.assert_facts(reduce(DataFrame.unionByName, rows))
            else:
                self.retract(reduce(DataFrame.unionByName, [r.select("id") for r in rows]))
        self.facts = cut(self.facts)

    def __init__(self, facts: DataFrame, rules: Iterable[Rule] = (), share: bool = False):
        """share: scan the facts once and join common chains of conditions once, for sets of many rules."""
        self.facts, self.rules, self.share = facts, list(rules), share

    def _activations(self) -> list[DataFrame]:
        if self.share and self.rules:
            return shared_activations(self.facts, self.rules)
        return [activations(self.facts, r, n) for n, r in enumerate(self.rules)]

    def add_rule(self, rule: Rule) -> None:
        if any(r.id == rule.id for r in self.rules):
            raise PolicyError(f"rule {rule.id} exists")
        self.rules.append(rule)

    def remove_rule(self, rule_id: str) -> None:
        self.rules = [r for r in self.rules if r.id != rule_id]

    def assert_facts(self, more: DataFrame) -> None:
        from ..operators.facts import merged

        self.facts = merged(self.facts, more)

    def retract(self, ids: DataFrame) -> None:
        """Facts with these ids go, and with them every activation they are part of."""
        self.facts = self.facts.join(ids.select("id").distinct(), "id", "left_anti")

    def agenda(self) -> DataFrame:
        """Activations in firing order: salience, then rule order, then facts; each once."""
        rows = [a.select(*AGENDA) for a in self._activations()]
        return reduce(DataFrame.unionByName, rows) if rows else self.facts.sparkSession.createDataFrame(
            [], "rule_id string, salience int, rule_ord int, fact_ids array<string>, bindings map<string,string>, fact_sources map<string,string>, guard_error string")

    def ordered(self) -> DataFrame:
        return self.agenda().orderBy(F.desc("salience"), "rule_ord", "fact_ids")

    def fire(self) -> DataFrame:
        """All consequences (unordered; order by salience desc, rule_ord, fact_ids, action_ord to see the firing order)."""
        out = [consequence(rows, r, k, a) for r, rows in zip(self.rules, self._activations()) for k, a in enumerate(r.actions)]
        return reduce(DataFrame.unionByName, out) if out else self.agenda().withColumns(
            {c: F.lit(None).cast(t) for c, t in (("action_ord", "int"), ("kind", "string"), ("action_type", "string"), ("message", "string"),
                                                 ("params", "array<string>"), ("data", "string"), ("unbound_variables", "array<string>"))})


def payload(consequences: DataFrame) -> DataFrame:
    """consequences with the JSON payload that hosts read."""
    fields = F.struct("action_type", "message", "params", F.when(F.size("unbound_variables") > 0, F.col("unbound_variables")).alias("unbound_variables"), "guard_error")
    told = F.to_json(fields)
    return consequences.withColumn("payload", F.when(F.col("data").isNull(), told).otherwise(
        F.concat(F.substring(told, F.lit(1), F.length(told) - 1), F.lit(',"data":'), F.col("data"), F.lit("}"))))


def reasons(consequences: DataFrame, demote: Iterable[str] = ()) -> DataFrame:
    """Severity of each consequence; blocks of demoted rules are warnings."""
    raw = F.when(F.col("action_type") == "constraint_violation", 2).when(F.col("action_type") == "constraint_warning", 1).otherwise(0)
    demoted = (raw == 2) & F.col("rule_id").isin(*list(demote) or [""])
    return consequences.withColumns({"demoted": demoted, "severity": F.when(demoted, 1).otherwise(raw)})


def verdict(consequences: DataFrame, demote: Iterable[str] = ()) -> DataFrame:
    """deny if anything blocks, else warn if anything warns, else allow; with the counts."""
    rank = F.coalesce(F.max("severity"), F.lit(0))
    return reasons(consequences, demote).agg(
        F.when(rank == 2, "deny").when(rank == 1, "warn").otherwise("allow").alias("verdict"),
        F.count_if(F.col("severity") == 2).alias("blocks"), F.count_if(F.col("severity") == 1).alias("warnings"))


def newest(consequences: DataFrame, order: str, keep: int = 10_000) -> DataFrame:
    """The store of consequences: the newest so many."""
    return consequences.orderBy(F.desc(order)).limit(keep)


def constraints(consequences: DataFrame, part: str = "") -> DataFrame:
    """Consequences that are constraints and whose rule id contains the part."""
    return consequences.where((F.col("kind") == "constraint") & F.col("rule_id").contains(part))


def governed(consequences: DataFrame, decisions: DataFrame) -> DataFrame:
    """consequences with the sorted decisions (rule, decision) that govern their rule as written."""
    from .policy import base_id_column

    by_rule = decisions.groupBy("rule").agg(F.array_sort(F.collect_set("decision")).alias("decisions"))
    return consequences.join(by_rule, base_id_column(F.col("rule_id")) == F.col("rule"), "left").drop("rule").withColumn(
        "decisions", F.coalesce("decisions", F.array().cast("array<string>")))


def action_types(consequences: DataFrame, order: str) -> DataFrame:
    """Distinct action types as first seen."""
    return consequences.groupBy("action_type").agg(F.min(order).alias("first")).orderBy("first")


def annotated_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Activations that are new: each fires once until one of its facts goes."""
    return now.join(before.select("rule_id", "fact_ids").distinct(), ["rule_id", "fact_ids"], "left_anti")


def occurrence(facts: DataFrame, order: str) -> DataFrame:
    """facts with their number among equal (predicate, args), from 0."""
    return facts.withColumn("occurrence", F.row_number().over(Window.partitionBy("predicate", "args").orderBy(order)) - 1)


def needed(rules: Iterable[Rule]) -> set[str]:
    """Predicates that some condition or guard names: only these relations are worth reading."""
    out = {c.predicate for r in rules for c in r.conditions if c.predicate}
    for script in (c.script for r in rules for c in r.conditions if c.script):
        guard = guards.parse(script)
        out |= {guard.predicate} if guard else set(CALLED.findall(script))
    return out


#: Predicates that an expression names in facts_contain, facts_count or a comparison, and expressions that read all facts.
CALLED = re.compile(r"""facts_(?:contain|count)\s*\(\s*["']([^"']*)["']""")
EVERY_FACT = re.compile(r"\bfacts\b")


def pruned(facts: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The facts of the needed predicates; a table partitioned by predicate is read only there. A guard that looks
    through all facts keeps them all."""
    rules = list(rules)
    if any(c.script and not guards.parse(c.script) and EVERY_FACT.search(c.script) for r in rules for c in r.conditions):
        return facts
    return facts.where(F.col("predicate").isin(*sorted(needed(rules)) or [""]))


def edited_files(files: DataFrame) -> DataFrame:
    """edited_file(path) facts, the context to which graph rules are scoped."""
    from ..operators.facts import facts_of

    return facts_of(files.select(F.col("file").alias("path")).distinct(), "edited_file", ["path"])


def graph_audit(facts: DataFrame, rules: Iterable[Rule], files: DataFrame) -> DataFrame:
    """Graph rules over the whole tree: every file counts as edited, and all rules fire once."""
    rules = list(rules)
    return Session(pruned(facts, rules).unionByName(edited_files(files)), rules).fire()
