"""Rule documents: strict parsing, OR expansion, layers, selection."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import guards
from ..model import PHASES, VERBS, Action, Condition, Layer, PolicyError, Rule

#: The keys that a rule object may have.
RULE_KEYS = {"id", "phase", "priority", "audit", "silent", "doc_excepted", "binds", "when", "then", "conditions", "actions"}
FLAGS = ("audit", "silent", "doc_excepted", "binds")
#: Expansions beyond this are reported.
MANY = 32
EXPANSION = re.compile(r"or\d+(-or\d+)*")
OVERRIDDEN = "rule_overridden"


def parse(text: str, source: str = "rules") -> tuple[list[Rule], list[str]]:
    """Flat rules of a document (either form), and diagnostics. Anything unknown is an error, and so is a guard that
    cannot be read: otherwise its rule would fire whatever holds."""
    try:
        document = json.loads(text)
        entries = document["rules"]
    except (ValueError, KeyError, TypeError) as e:
        raise PolicyError(f"{source}: not a rules document ({e})") from e
    first: dict[str, dict] = {}
    rules: list[Rule] = []
    notes: list[str] = []
    for entry in entries:
        if not isinstance(entry, dict) or not isinstance(entry.get("id"), str) or not entry["id"]:
            raise PolicyError(f"{source}: a rule without an id")
        known = first.setdefault(entry["id"], entry)
        if known is not entry:
            if known != entry:
                raise PolicyError(f"{source}: two different rules with the id {entry['id']}")
            notes.append(f"duplicate_identical:{entry['id']}")
            continue
        flat = expand(entry, source)
        for rule in flat:
            for script in (c.script for c in rule.conditions if c.script):
                if said := guards.unreadable(script, rule.bound()):
                    raise PolicyError(f"{source}: rule {rule.id}: guard: {said}")
        if len(flat) > MANY:
            notes.append(f"large_expansion:{entry['id']}:{len(flat)}")
        rules += flat
    return rules, list(dict.fromkeys(notes))


def expand(entry: dict, source: str = "rules") -> list[Rule]:
    """One rule for each choice of a branch at each OR (nested ones flattened), with ids like r#or0-or1."""
    where = f"{source}: rule {entry['id']}"
    if extra := set(entry) - RULE_KEYS:
        raise PolicyError(f"{where}: unknown keys {sorted(extra)}")
    phase, priority = entry.get("phase", "pre"), entry.get("priority", 0)
    if phase not in PHASES:
        raise PolicyError(f"{where}: unknown phase {phase!r}")
    if not isinstance(priority, int) or isinstance(priority, bool):
        raise PolicyError(f"{where}: priority is not an integer")
    if "when" in entry and "conditions" in entry or "then" in entry and "actions" in entry:
        raise PolicyError(f"{where}: both forms at once")
    if "when" in entry:
        if not entry["when"]:
            raise PolicyError(f"{where}: empty when")
        choices = [branches(clause, where) for clause in entry["when"]]
        actions = (then(entry.get("then"), where),)
    else:
        choices = [[Condition(c.get("predicate", ""), tuple(c.get("args", ())), c.get("script"))] for c in entry.get("conditions", [])]
        actions = tuple(Action(_known_type(a.get("action_type"), where), tuple(a.get("params", ())), a.get("data")) for a in entry.get("actions", []))
    out = []
    for pick in itertools.product(*(range(len(c)) for c in choices)):
        path = "-".join(f"or{i}" for i, c in zip(pick, choices) if len(c) > 1)
        out.append(Rule(f"{entry['id']}#{path}" if path else entry["id"], tuple(c[i] for i, c in zip(pick, choices)), actions, priority, phase,
                        **{k: entry.get(k) for k in FLAGS}))
    return out


def branches(clause: dict, where: str) -> list[Condition]:
    if not isinstance(clause, dict) or len(clause) != 1:
        raise PolicyError(f"{where}: a clause has one key")
    (key, value), = clause.items()
    if key == "or":
        if not value:
            raise PolicyError(f"{where}: an empty or holds for nothing")
        return [c for sub in value for c in branches(sub, where)]
    if key == "__script__":
        return [Condition(script=value)]
    if value is True:
        return [Condition(key)]
    if isinstance(value, str):
        return [Condition(key, (value,))]
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return [Condition(key, tuple(value))]
    raise PolicyError(f"{where}: arguments of {key} are not strings")


def then(value, where: str) -> Action:
    if not isinstance(value, dict) or len(value) != 1:
        raise PolicyError(f"{where}: then has one verb")
    (verb, told), = value.items()
    kind = VERBS.get(verb) or _known_type(verb, where)
    return Action(kind, (), told) if kind == "emit_capsule" else Action(kind, tuple(told) if isinstance(told, list) else (str(told),))


def _known_type(kind, where: str) -> str:
    if kind not in VERBS.values():
        raise PolicyError(f"{where}: unknown action {kind!r}")
    return kind


def base_id(rule_id: str) -> str:
    """The id as written, without an expansion's suffix."""
    base, _, suffix = rule_id.partition("#")
    return base if EXPANSION.fullmatch(suffix) else rule_id


def base_id_column(c: Column) -> Column:
    return F.regexp_replace(c, r"#or\d+(-or\d+)*$", "")


def select(rules: Sequence[Rule], phase: str | None = None, audit: bool = False, ids: set[str] | None = None) -> list[Rule]:
    """Rules of a phase; or for the audit, those marked for it whatever their phase. ids may name unexpanded rules."""
    kept = [r for r in rules if (r.audit or r.phase == "audit" if audit else phase != "none" and r.phase == phase)]
    return [r for r in kept if ids is None or r.id in ids or base_id(r.id) in ids]


def compose(layers: Sequence[Layer]) -> tuple[list[Rule], list[dict]]:
    """Later rules of the same id take the earlier one's place; each replacement is an override, even if equal."""
    place: dict[str, Rule] = {}
    origin: dict[str, Layer] = {}
    overrides = []
    for layer in layers:
        for rule in layer.rules:
            if rule.id in place:
                overrides.append({"rule": rule.id, "loser": origin[rule.id], "winner": layer})
            place[rule.id], origin[rule.id] = rule, layer
    return list(place.values()), overrides


def load_layers(sources: Sequence[tuple[str, str | None, bool]]) -> tuple[list[Layer], list[dict]]:
    """Layers of rule documents (name, text, required) in order, each with the rules it contributes to the whole, and the
    overrides. A document that is not there (None) is skipped unless it is required."""
    layers = []
    for name, text, required in sources:
        if text is None:
            if required:
                raise PolicyError(f"{name}: the rules document is missing")
            continue
        layers.append(Layer(name, name, tuple(parse(text, name)[0])))
    won, overrides = compose(layers)
    kept = {id(r) for r in won}
    return [Layer(x.name, x.source, tuple(r for r in x.rules if id(r) in kept), x.decision) for x in layers], overrides


def override_facts(spark: SparkSession, overrides: Sequence[dict], timestamp: int = 0) -> DataFrame:
    rows = [(f"__rule_override__:{i}:{o['rule']}", OVERRIDDEN,
             [o["rule"], o["loser"].name, o["loser"].source, o["winner"].name, o["winner"].source, o["winner"].decision or ""], timestamp, "rule_layers")
            for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, "id string, predicate string, args array<string>, timestamp long, source string")


def compose_tables(layered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for a table (layer int, ord, rule_id and others): the winners at the place of the first of their id,
    and one override row for each replacement in layer order."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule_id").orderBy("layer", "ord")
    marked = layered.withColumns({"before": F.lag("layer").over(w), "after": F.lead("layer").over(w),
                                  "place_layer": F.first("layer").over(w), "place_ord": F.first("ord").over(w)})
    return (marked.where("after IS NULL").drop("before", "after"),
            marked.where("before IS NOT NULL").select("rule_id", F.col("before").alias("loser_layer"), F.col("layer").alias("winner_layer")))


def all_any(clause: dict, most: int = 64) -> list[list[str]]:
    """Alternatives (lists of tests) of a nested {"all": [...]}, {"any": [...]} or {"is": test}; an error beyond a cap."""
    def walk(c: dict) -> list[list[str]]:
        if not isinstance(c, dict) or len(c) != 1:
            raise PolicyError("a clause has one key")
        (key, value), = c.items()
        if key == "is":
            return [[value]]
        if key not in ("all", "any") or not value:
            raise PolicyError(f"unknown or empty clause {key!r}")
        parts = [walk(v) for v in value]
        out = [p for part in parts for p in part] if key == "any" else [sum(pick, []) for pick in itertools.product(*parts)]
        if len(out) > most:
            raise PolicyError(f"more than {most} alternatives")
        return out
    return [list(dict.fromkeys(a)) for a in walk(clause)]
