"""Guards: existence, absence and counts of facts, compiled to joins; all others are compiled by ``expressions``.

A guard that cannot be parsed does not silence its rule: the rule fires and carries the error.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import VARIABLE

COUNT = re.compile(r"facts_count\((?P<inner>[^()]*)\)\s*(?P<op>>=|<=|==|>|<)\s*(?P<n>\d+)\s*")
CONTAIN = re.compile(r"facts_contain\((?P<inner>[^()]*)\)")
CALL = re.compile(r"""\s*(?P<predicate>[^\[\]]*?)\s*,\s*\[(?P<args>[^\[\]]*)\]\s*""")


@dataclass(frozen=True)
class Guard:
    negated: bool
    predicate: str
    args: tuple[str, ...]
    op: str | None = None  # None: existence
    n: int = 0


def parse(script: str) -> Guard | None:
    """A built-in guard, or None."""
    text = script.strip()
    negated = text.startswith("!")
    text = text[1:].strip() if negated else text
    found = COUNT.fullmatch(text) or CONTAIN.fullmatch(text)
    call = found and CALL.fullmatch(found["inner"])
    if not call:
        return None
    args = tuple(a.strip().strip("'").strip('"') for a in call["args"].split(",")) if call["args"].strip() else ()
    predicate = call["predicate"].strip("'").strip('"')
    if found.re is COUNT:
        return Guard(negated, predicate, args, found["op"], int(found["n"]))
    return Guard(negated, predicate, args)


def template(text: str, bound: dict[str, Column]) -> Column:
    """The text with each bound variable replaced; unbound ones stay as they are."""
    out, at = [], 0
    for m in VARIABLE.finditer(text):
        if m[0] in bound:
            out += [F.lit(text[at:m.start()]), bound[m[0]]]
            at = m.end()
    out.append(F.lit(text[at:]))
    return out[0] if len(out) == 1 else F.concat(*out)


def apply(rows: DataFrame, facts: DataFrame, guard: Guard, bound: set[str]) -> DataFrame:
    """The rows (columns named like their variables) for which the guard holds."""
    fixed, free = [], []
    for i, a in enumerate(guard.args):
        if a != "*":
            (free if any(v in bound for v in VARIABLE.findall(a)) else fixed).append((i, a))
    arity = F.size("args") >= len(guard.args) if guard.op else F.size("args") == len(guard.args)
    there = facts.where((F.col("predicate") == guard.predicate) & arity)
    for i, a in fixed:
        there = there.where(F.col("args")[i] == a)
    keys = {f"__g{i}": F.col("args")[i] for i, _ in free}
    there = there.select(*[c.alias(k) for k, c in keys.items()], F.lit(1).alias("__one"))
    if not free:
        n = there.agg(F.count("*").alias("__n"))
        held = _compare(F.col("__n"), guard) if guard.op else F.col("__n") > 0
        return rows.join(F.broadcast(n.where(~held if guard.negated else held)), F.lit(True), "left_semi")  # one row at most
    wanted = {f"__g{i}": template(a, {v: F.col(f"`{v}`") for v in bound}) for i, a in free}
    on = [wanted[k] == F.col(k) for k in keys]
    if guard.op is None:
        return rows.join(there.distinct(), on, "left_anti" if guard.negated else "left_semi")
    counts = there.groupBy(*keys).agg(F.count("*").alias("__n"))
    held = _compare(F.coalesce("__n", F.lit(0)), guard)
    return rows.join(counts, on, "left").where(~held if guard.negated else held).drop("__n", *keys)


def _compare(n: Column, guard: Guard) -> Column:
    return {">=": n >= guard.n, ">": n > guard.n, "==": n == guard.n, "<=": n <= guard.n, "<": n < guard.n}[guard.op]


def unreadable(script: str, bound: set[str]) -> str | None:
    """Why a guard cannot be read, or None."""
    from . import expressions

    try:
        return None if parse(script) else expressions.compiled(script, bound) and None
    except expressions.Malformed as e:
        return str(e)


def route(script: str, bound: set[str]) -> str:
    """How a guard is evaluated: builtin (one fact test), compiled (any other expression) or error."""
    return "builtin" if parse(script) else "error" if unreadable(script, bound) else "compiled"
