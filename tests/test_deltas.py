"""Counted deltas: any sequence of assertions and retractions gives what an evaluation from nothing gives."""

import random

import pytest

from rulelake.model import Action, Condition, Rule
from rulelake.plans import deltas, rules

FACT = "id string, predicate string, args array<string>, timestamp long, source string"
LOG = FACT + ", d int, seq int"


def cond(predicate, *args):
    return Condition(predicate, args)


def rule(*conditions, scripts=()):
    return Rule("r", (*conditions, *[Condition(script=s) for s in scripts]), (Action("log", ("?x",)),))


RULES = {
    "self_join": rule(cond("e", "?x", "?y"), cond("e", "?y", "?z")),
    "repeated": rule(cond("e", "?x", "?x"), cond("n", "?x")),
    "cartesian": rule(cond("n", "?x"), cond("m", "?y")),
    "absent": rule(cond("e", "?x", "?y"), scripts=["!facts_contain('n', ['?y'])"]),
    "count_and_contain": rule(cond("n", "?x"), scripts=["facts_count('e', ['?x']) <= 1", "facts_contain('e', ['*', '*'])"]),
    "global_count": rule(cond("n", "?x"), cond("e", "?x", "?y"), scripts=["facts_count('m', []) == 2"]),
    "expressions": rule(cond("n", "?x"), scripts=["facts.some(|f| f.predicate == \"e\" && f.args[0] == bindings[\"?x\"] && f.args[1].parse_int() > 1) || facts_count('m', ['?x']) > 0",
                                                  "facts.filter(|f| f.predicate == \"m\" && f.args[0].parse_int() < bindings[\"?x\"].parse_int()).len() < 2"]),
}


def random_fact(r):
    predicate = r.choice("eenm")
    args = [str(r.randint(0, 3)) for _ in range(2 if predicate == "e" else 1)]
    return f"{predicate}{r.randint(0, 9)}", predicate, args, 0, r.choice(["s", None])


def keys(df):
    return {(tuple(x.fact_ids), x.guard_error, tuple(sorted(x.bindings.items()))) for x in df.collect()}


@pytest.mark.parametrize("name", RULES)
def test_random_changes_equal_an_evaluation_from_nothing(spark, name):
    r = random.Random(name)
    state = {f[0]: f for f in (random_fact(r) for _ in range(12))}
    kept = deltas.Incremental(spark.createDataFrame(list(state.values()), FACT), RULES[name])
    held = keys(kept.agenda())
    for _ in range(2):
        log = []
        for seq in range(r.randint(1, 6)):
            if r.random() < 0.5:
                f = random_fact(r)
                log.append((*f, 1, seq))
                state[f[0]] = f if f[0] not in state or state[f[0]][1:3] != f[1:3] else state[f[0]]
            else:
                gone = r.choice([*state, "nobody"])
                log.append((gone, None, None, None, None, -1, seq))
                state.pop(gone, None)
        delta = kept.change(spark.createDataFrame(log, LOG))
        signs = [(x.d, (tuple(x.fact_ids), x.guard_error, tuple(sorted(x.bindings.items())))) for x in delta.collect()]
        came, went = {k for d, k in signs if d == 1}, {k for d, k in signs if d == -1}
        assert len(came) + len(went) == len(signs) and not came & held and went <= held
        held = held - went | came
        fresh = rules.activations(spark.createDataFrame(list(state.values()), FACT), RULES[name])
        assert held == keys(fresh) == keys(kept.agenda())
    kept.drop()


def test_a_log_entry_is_overruled_by_later_ones(spark):
    facts = spark.createDataFrame([("a", "n", ["1"], 0, "s"), ("b", "n", ["2"], 0, "s")], FACT)
    log = [("a", None, None, None, None, -1, 0), ("a", "n", ["1"], 5, "t", 1, 1), ("b", "n", ["3"], 0, "s", 1, 2), ("c", "n", ["4"], 0, "s", 1, 3), ("c", None, None, None, None, -1, 4), ("d", None, None, None, None, -1, 5)]
    got = sorted((x.id, x.args[0], x.d) for x in deltas.signed(facts, spark.createDataFrame(log, LOG)).collect())
    assert got == [("b", "2", -1), ("b", "3", 1)]
