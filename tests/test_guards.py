"""Guards with names, choices, lists and nested tests of facts, against plain Python over every binding."""

import random

import pytest

from rulelake.model import Action, Condition, PolicyError, Rule
from rulelake.plans import expressions, guards, policy, rules

FACT = "id string, predicate string, args array<string>, timestamp long, source string"


def table(spark, seed=2):
    r = random.Random(seed)
    rows = [("x", [str(i), r.choice(["red", "blue", "a-b-red", ""])]) for i in range(9)]
    rows += [("a", [str(r.randint(0, 9)), str(r.randint(0, 4))]) for _ in range(14)] + [("b", [str(r.randint(0, 4))]) for _ in range(4)]
    return rows, spark.createDataFrame([(f"f{i}", p, a, 0, "s") for i, (p, a) in enumerate(rows)], FACT)


def of(facts, predicate):
    return [a for p, a in facts if p == predicate]


GUARDS = {
    'let n = bindings["?i"].parse_int(); let m = n + 1; m * 2 > 7': lambda f, i, c: (int(i) + 1) * 2 > 7,
    'if bindings["?c"] == "red" { bindings["?i"].parse_int() > 3 } else if bindings["?c"].is_empty() { true } else { facts.len() < 3 }': lambda f, i, c: int(i) > 3 if c == "red" else c == "" or len(f) < 3,
    '["red", "blue"].contains(bindings["?c"]) && !(bindings["?i"] in ["1", "2", "3"])': lambda f, i, c: c in ("red", "blue") and i not in "123",
    'bindings["?i"].parse_int() in [1, 2, 2 + 3]': lambda f, i, c: int(i) in (1, 2, 5),
    'bindings["?c"].split("-").some(|p| p == "red" || p.len() == 4)': lambda f, i, c: any(p == "red" or len(p) == 4 for p in c.split("-")),
    'bindings["?c"].split("-").filter(|p| p != "a").map(|p| p.to_upper())[0] in ["B", "BLUE"]': lambda f, i, c: next((p.upper() for p in c.split("-") if p != "a"), None) in ("B", "BLUE") if [p for p in c.split("-") if p != "a"] else None,
    'facts.filter(|f| f.predicate == "a").map(|f| f.args[0]).contains(bindings["?i"])': lambda f, i, c: i in [a[0] for a in of(f, "a")],
    'let v = facts.filter(|f| f.predicate == "a" && f.args[0] == bindings["?i"]).map(|f| f.args[1].parse_int()); v.some(|x| x > 2) && v.all(|x| x > 0) && v.filter(|x| x < 4).len() <= 1':
        lambda f, i, c: any(int(a[1]) > 2 for a in of(f, "a") if a[0] == i) and all(int(a[1]) > 0 for a in of(f, "a") if a[0] == i) and sum(int(a[1]) < 4 for a in of(f, "a") if a[0] == i) <= 1,
    'facts.some(|f| f.predicate == "a" && f.args[0] == bindings["?i"] && facts.some(|g| g.predicate == "b" && g.args[0] == f.args[1]))':
        lambda f, i, c: any(a[0] == i and [a[1]] in of(f, "b") for a in of(f, "a")),
    'facts.filter(|f| f.predicate == "a" && !facts_contain("b", ["*"]) || f.predicate == "a" && facts.filter(|g| g.predicate == "b" && g.args[0] != f.args[1] && g.args[0] <= bindings["?i"]).len() >= 2).len() > 3':
        lambda f, i, c: sum(not of(f, "b") or sum(g[0] != a[1] and g[0] <= i for g in of(f, "b")) >= 2 for a in of(f, "a")) > 3,
    'facts.all(|f| if f.predicate == "a" { f.args[0] != bindings["?i"] || facts.some(|g| g.predicate == "b" && facts.some(|h| h.predicate == "x" && h.args[0] == g.args[0] && h.args[0] != f.args[1])) } else { true })':
        lambda f, i, c: all(a[0] != i or any(any(h[0] == g[0] and h[0] != a[1] for h in of(f, "x")) for g in of(f, "b")) for a in of(f, "a")),
    '["0", "4"].some(|v| facts.some(|f| f.predicate == "b" && f.args[0] == v)) && facts.some(|f| f.predicate == "x" && bindings["?i"] in f.args)': lambda f, i, c: any([v] in of(f, "b") for v in "04") and any(i in a for a in of(f, "x")),
}


@pytest.mark.parametrize("seed", [3])
def test_guards_against_plain_python(spark, seed):
    facts, df = table(spark, seed)
    for script, want in GUARDS.items():
        assert guards.route(script, {"?i", "?c"}) == "compiled"
        rule = Rule("r", (Condition("x", ("?i", "?c")), Condition(script=script)), (Action("log", ("?i",)),))
        got = {(r.bindings["?i"], r.bindings["?c"]): r.guard_error for r in rules.activations(df, rule).collect()}
        told = {(i, c): want(facts, i, c) for i, c in of(facts, "x")}
        assert got == {k: None if v else "guard: no value" for k, v in told.items() if v or v is None}, script


@pytest.mark.parametrize("script", ["let x = 1", "if true { 1 } else { true }", "if true { true }", "let facts = 1; true", '["a", 1].len() > 0', "facts.map(|f| f).len() > 0", "[[1]].len() > 0",
                                    'bindings["?c"].split("-").some(|p| facts.some(|f| f.args[0] == p))', "facts in facts", "x == 1", "let x = 1; x", "facts.filter(|f| f.args[0])", "1 in [\"a\"]", "{ true }"])
def test_what_cannot_be_read_is_refused_when_rules_are_loaded(script):
    assert guards.route(script, {"?c"}) == "error"
    with pytest.raises(expressions.Malformed):
        expressions.compiled(script, {"?c"})
    import json

    document = json.dumps({"rules": [{"id": "r", "when": [{"x": ["?i", "?c"]}, {"__script__": script}], "then": {"log": "?i"}}]})
    with pytest.raises(PolicyError, match="guard"):
        policy.parse(document)
