import itertools
import json

import pytest

from rulelake.model import Action, Condition, Layer, PolicyError, Rule
from rulelake.operators import facts
from rulelake.plans import guards, policy, rules

FACT = "id string, predicate string, args array<string>, timestamp long, source string"


def table(spark, *rows):
    return spark.createDataFrame([(*r, 0, None)[:5] if len(r) == 3 else r for r in rows], FACT)


def cond(p, *a):
    return Condition(p, a)


def warn(*p):
    return Action("constraint_warning", p)


@pytest.fixture(scope="module")
def people(spark):
    return table(spark, ("e1", "equipped", ["alice", "head", "helm"]), ("e2", "equipped", ["alice", "hand", "sword"]),
                 ("e3", "equipped", ["bob", "head", "cap"]), ("g1", "gold", ["alice", "30"]))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_scans(spark, people):
    assert [r.id for r in facts.snapshot(people).collect()] == ["e1", "e2", "e3", "g1"]
    assert ids(facts.matching(people, "equipped", [(0, "alice")])) == ["e1", "e2"]
    assert ids(facts.matching(people, "equipped", [(9, "alice")])) == []
    assert ids(facts.by_predicates(people, ["gold", "equipped"])) == ["e1", "e2", "e3", "g1"]
    assert ids(facts.merged(people, people)) == ["e1", "e2", "e3", "g1"]
    with pytest.raises(PolicyError):
        facts.merged(people, table(spark, ("e1", "equipped", ["other"])))
    with pytest.raises(PolicyError):
        facts.validate(people, table(spark, ("x", "gold", ["1"])), ["gold"])
    with pytest.raises(PolicyError):
        facts.validate(people, table(spark, ("e1", "new", ["1"])), [])
    assert facts.oversized(table(spark, ("a", "p", ["x"] * 300), ("b", "p", ["x"]))).count() == 1


@pytest.mark.parametrize("names", list(itertools.permutations("pqr")))
def test_join_order_does_not_matter(spark, names):
    f = table(spark, ("1", "p", ["a"]), ("2", "q", ["a"]), ("3", "r", ["a"]), ("4", "q", ["b"]))
    assert rules.activations(f, Rule("r", tuple(cond(n, "?x") for n in names), (warn("?x"),))).count() == 1


def test_arity_self_join_and_cartesian(spark, people):
    one = rules.activations(people, Rule("r", (cond("gold", "?x"),), ()))
    assert one.count() == 0  # gold has two arguments
    assert rules.activations(people, Rule("r", (cond("equipped", "?a", "?s", "?i"), cond("equipped", "?b", "?s", "?j")), ())).count() == 5
    assert rules.activations(people, Rule("r", (cond("gold", "?a", "?n"), cond("equipped", "?b", "head", "?j")), ())).count() == 2


def test_guards(spark, people):
    def fired(script):
        r = Rule("r", (cond("equipped", "?who", "?slot", "?item"), Condition(script=script)), (warn("?who ?item"),))
        return sorted((x.message, x.guard_error) for x in rules.Session(people, [r]).fire().collect())

    alice = [("alice helm", None), ("alice sword", None)]
    assert fired("facts_contain('gold', ['?who', '*'])") == alice
    assert fired("!facts_contain('gold', ['?who', '*'])") == [("bob cap", None)]
    assert fired("facts_contain('gold', ['?who'])") == []  # exact arity
    assert fired("facts_count('equipped', ['?who']) >= 2") == alice  # prefix arity
    assert fired("facts_count('gold', ['?who']) == 0") == [("bob cap", None)]
    assert fired("!facts_count('gold', ['*']) > 0") == [] and len(fired("facts_count('none', ['*']) < 1")) == 3
    assert fired("b['?item'] == 'cap'") == [("bob cap", None)]
    assert all("guard: " in e for _, e in fired("b['?nope'] == 1")) and len(fired("b['?nope'] == 1")) == 3
    assert all("guard: " in e for _, e in fired("__import__('os')")) and len(fired("1 + 1")) == 3
    assert guards.parse("facts_contain('p', [])") == guards.Guard(False, "p", ())


def test_firing_order_substitution_and_verdict(spark, people):
    a = Rule("low", (cond("gold", "?who", "?n"),), (Action("log", ("?who has ?n", "?nothing"), {"k": ["?who", {"z": "?x"}], "n": 1}),), 1)
    b = Rule("high", (cond("equipped", "?w", "head", "?i"),), (Action("constraint_violation", ("?i?i2 of ?w",)),), 9)
    c = Rule("note", (cond("gold", "?who", "?n"),), (Action("emit_capsule", (), {"id": "?who", "body": "for ?who"}),), 0)
    s = rules.Session(people, [a, b, c])
    assert [r.rule_id for r in s.ordered().collect()] == ["high", "high", "low", "note"]
    fired = {(r.rule_id, r.message): r for r in rules.payload(s.fire()).collect()}
    low = fired[("low", "alice has 30 ?nothing")]
    assert json.loads(low.data) == {"k": ["alice", {"z": "?x"}], "n": 1} and low.unbound_variables == ["?nothing", "?x"]
    assert low.kind == "event" and json.loads(low.payload)["message"] == "alice has 30 ?nothing" and json.loads(low.payload)["data"]["n"] == 1
    assert fired[("high", "helm?i2 of alice")].kind == "constraint"
    assert json.loads(fired[("note", "")].data) == {"id": "?who", "body": "for alice"}
    assert rules.verdict(s.fire()).first().verdict == "deny"
    assert rules.verdict(s.fire(), ["high"]).first().asDict() == {"verdict": "warn", "blocks": 0, "warnings": 2}
    assert rules.verdict(rules.Session(people, [a]).fire()).first().verdict == "allow"
    assert rules.verdict(rules.Session(people, []).fire()).first().verdict == "allow"
    assert a.unbound_variables() == ["?nothing", "?x"]
    s.retract(spark.createDataFrame([("g1",)], "id string"))
    assert {r.rule_id for r in s.agenda().collect()} == {"high"}
    with pytest.raises(PolicyError):
        s.add_rule(a)


def test_sources_and_decisions(spark):
    f = spark.createDataFrame([("a", "p", ["1"], 0, "file.rs"), ("b", "q", ["1"], 0, None)], FACT)
    fired = rules.Session(f, [Rule("r#or0", (cond("p", "?x"), cond("q", "?x")), (warn("m"),))]).fire()
    assert fired.first().fact_sources == {"a": "file.rs"}
    dec = spark.createDataFrame([("r", "d2"), ("r", "d1"), ("z", "d3")], "rule string, decision string")
    assert rules.governed(fired, dec).first().decisions == ["d1", "d2"]
    assert rules.constraints(fired, "or0").count() == 1 and rules.constraints(fired, "x").count() == 0


def test_policy_parsing():
    text = {"rules": [{"id": "r", "phase": "audit", "when": [{"or": [{"a": "?x"}, {"or": [{"b": ["?x", "k"]}, {"c": True}]}]}, {"or": [{"d": "1"}, {"e": "1"}]}, {"or": [{"f": "1"}]}],
                       "then": {"block": "no"}}, {"id": "s", "when": [{"__script__": "facts_count('p',['*']) >= 2"}], "then": {"emit_capsule": {"id": "i", "body": "x"}}}]}
    flat, notes = policy.parse(json.dumps(text))
    assert [r.id for r in flat] == [f"r#or{i}-or{j}" for i in range(3) for j in range(2)] + ["s"] and notes == []
    assert flat[2].conditions == (cond("b", "?x", "k"), cond("d", "1"), cond("f", "1")) and flat[0].actions[0].action_type == "constraint_violation"
    assert flat[-1].conditions[0].script and flat[-1].actions[0].data == {"id": "i", "body": "x"}
    assert policy.base_id("r#or0-or1") == "r" and policy.base_id("r#order") == "r#order"
    assert [r.id for r in policy.select(flat, audit=True)][:1] == ["r#or0-or0"] and [r.id for r in policy.select(flat, "pre")] == ["s"]
    assert len(policy.select(flat, audit=True, ids={"r"})) == 6
    twice, notes = policy.parse(json.dumps({"rules": [text["rules"][1]] * 2}))
    assert len(twice) == 1 and notes == ["duplicate_identical:s"]
    bad = [{"when": [{"or": []}]}, {"when": []}, {"Phase": "pre"}, {"phase": "Pre"}, {"then": {"explode": "x"}}, {"priority": "1"}, {"when": [{"a": 1}]}, {"when": [{"a": "x", "b": "y"}]}]
    for change in bad:
        with pytest.raises(PolicyError):
            policy.parse(json.dumps({"rules": [{"id": "r", "when": [{"a": "x"}], "then": {"warn": "m"}} | change]}))
    with pytest.raises(PolicyError):
        policy.parse(json.dumps({"rules": [text["rules"][1], {**text["rules"][1], "priority": 3}]}))
    with pytest.raises(PolicyError):
        policy.parse("[]")
    big = {"id": "b", "when": [{"or": [{"p": str(i)} for i in range(6)]}] * 2, "then": {"log": "x"}}
    assert policy.parse(json.dumps({"rules": [big]}))[1] == ["large_expansion:b:36"]


def test_layers(spark):
    def one(i, p):
        return Rule(i, (cond("a", "?x"),), (warn("m"),), p)

    layers = [Layer("pack", "p1", (one("a", 1), one("b", 1))), Layer("project", "q", (one("a", 1),), "d7"), Layer("local", "l", (one("c", 1), one("a", 3)))]
    won, over = policy.compose(layers)
    assert [(r.id, r.priority) for r in won] == [("a", 3), ("b", 1), ("c", 1)]
    got = policy.override_facts(spark, over).orderBy("id").collect()
    assert [r.args for r in got] == [["a", "pack", "p1", "project", "q", "d7"], ["a", "project", "q", "local", "l", ""]]


def test_compound_guards_and_guards_over_facts(spark, people):
    def fired(script):
        r = Rule("r", (cond("equipped", "?who", "?slot", "?item"), Condition(script=script)), (warn("?who ?item"),))
        return sorted((x.message, x.guard_error) for x in rules.Session(people, [r]).fire().collect())

    every, alice, bob = 3, [("alice helm", None), ("alice sword", None)], [("bob cap", None)]
    assert fired("facts_contain('gold', ['?who', '*']) && facts_contain('equipped', ['?who', 'head', 'helm'])") == alice
    assert fired("facts_contain('gold', ['?who', '*']) && !facts_contain('equipped', ['?who', 'head', 'helm'])") == []
    assert fired("facts_contain('nothing', []) || facts_count('equipped', ['?who']) < 2") == bob
    assert fired('facts.some(|f| f.predicate == "gold" && f.args[0] == bindings["?who"] && f.args[1].parse_int() >= 5)') == alice
    assert fired('!facts.some(|f| f.predicate == "gold" && f.args[0] == bindings["?who"])') == bob
    assert fired('facts.some(|f| f.predicate == "gold" && bindings["?item"].len() < f.args[0].len() && f.args[0] != bindings["?who"])') == bob
    assert fired('facts.filter(|f| f.predicate == "equipped").len() == 3 and bindings["?item"].contains("a")') == bob
    assert len(fired('facts.all(|f| f.args.len() >= 2)')) == every and fired('facts.all(|f| f.predicate == "gold")') == []
    assert fired("b['?item'].len() * 2 + 1 > 7 && 'l' in b['?item']") == [("alice helm", None)]
    assert [x for _, x in fired("b['?item'].parse_int() > 1")] == ["guard: no value"] * every
    for bad in ("facts.len()", "facts.some(|f| f.size > 1)", "eval('1')", "1 < 'a'", "(" * 100 + "true" + ")" * 100, "true " * 2000, "facts_contain('gold', ['?who'])) || true"):
        assert [x.split(":")[0] for _, x in fired(bad)] == ["guard"] * every, bad
    found = rules.needed([Rule("r", (Condition(script="facts_contain('a', []) && facts_count('b', ['*']) > 1"),), ())])
    assert found == {"a", "b"}
