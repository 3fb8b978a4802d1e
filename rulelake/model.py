"""Rules, conditions and actions, and the shape of fact tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

FACT = "id string, predicate string, args array<string>, timestamp bigint, source string"

#: A variable: a question mark before an ASCII identifier.
VARIABLE = re.compile(r"\?[A-Za-z_][A-Za-z0-9_]*")

#: Verbs of rule files and the action types that they stand for.
VERBS = {"block": "constraint_violation", "warn": "constraint_warning", "log": "log", "emit_capsule": "emit_capsule"}
PHASES = ("pre", "post", "audit", "none")


class PolicyError(ValueError):
    """A rule document, layer or snapshot that must not be evaluated."""


@dataclass(frozen=True)
class Condition:
    predicate: str = ""
    args: tuple[str, ...] = ()
    script: str | None = None


@dataclass(frozen=True)
class Action:
    action_type: str
    params: tuple[str, ...] = ()
    data: Any = None

    def texts(self) -> list[str]:
        """Every string in which variables are replaced."""
        return [*self.params, *_strings(self.data)]


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple[Condition, ...]
    actions: tuple[Action, ...]
    priority: int = 0
    phase: str = "pre"
    audit: bool | None = None
    silent: bool | None = None
    doc_excepted: bool | None = None
    binds: bool | None = None

    def bound(self) -> set[str]:
        return {a for c in self.conditions for a in c.args if is_variable(a)}

    def unbound_variables(self) -> list[str]:
        """Variables of the actions that no condition binds, as first seen; they are rendered as they stand."""
        seen: dict[str, None] = {}
        for text in (t for a in self.actions for t in a.texts()):
            seen |= {v: None for v in VARIABLE.findall(text) if v not in self.bound()}
        return list(seen)


@dataclass(frozen=True)
class Layer:
    name: str
    source: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)
    decision: str | None = None


def is_variable(arg: str) -> bool:
    return VARIABLE.fullmatch(arg) is not None


def _strings(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else []
