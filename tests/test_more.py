import pytest
from pyspark.sql import functions as F

from rulelake.functions import text as T
from rulelake.model import Action, Condition, PolicyError, Rule
from rulelake.operators import drift, graph, journey
from rulelake.plans import policy, rules

FACT = "id string, predicate string, args array<string>, timestamp long, source string"


def test_demand_and_graph_audit(spark):
    f = spark.createDataFrame([("1", "defines", ["a.rs", "f"], 0, None), ("2", "defines", ["b.rs", "g"], 0, None), ("3", "other", ["x"], 0, None), ("4", "tested", ["g"], 0, None)], FACT)
    r = Rule("untested", (Condition("edited_file", ("?file",)), Condition("defines", ("?file", "?fn")), Condition(script="!facts_contain('tested', ['?fn'])")), (Action("constraint_warning", ("?fn",)),))
    assert rules.needed([r]) == {"edited_file", "defines", "tested"} and rules.pruned(f, [r]).count() == 3
    files = spark.createDataFrame([("a.rs",), ("b.rs",), ("b.rs",)], "file string")
    assert [x.message for x in rules.graph_audit(f, [r], files).collect()] == ["f"]


def test_alternatives():
    assert policy.all_any({"all": [{"is": "a"}, {"any": [{"is": "b"}, {"all": [{"is": "c"}, {"is": "a"}]}]}]}) == [["a", "b"], ["a", "c"]]
    for bad in ({"any": []}, {"not": [1]}, {"is": "a", "any": []}):
        with pytest.raises(PolicyError):
            policy.all_any(bad)
    with pytest.raises(PolicyError):
        policy.all_any({"all": [{"any": [{"is": str(i)} for i in range(9)]}] * 2})


def test_reports(spark):
    rep = spark.createDataFrame([("s", "moves"), ("t", "moves"), ("t", "locks")], "subject string, capability string")
    assert [(r.subject, r.capability) for r in graph.not_reported(rep, ["moves", "locks"]).collect()] == [("s", "locks")]
    bound = spark.createDataFrame([("r", "f", "bound", []), ("r", "g", "moved", ["x", "y"])], "rule string, symbol string, state string, relocated array<string>")
    assert [(r.symbol, r.state, r.now_at) for r in drift.code(bound).collect()] == [("g", "moved", "x,y")]


def test_window_facts_name_their_rules(spark):
    c = lambda p, *a: Condition(p, a)
    asked = [Rule("a", (c("journey_count", "sql", "s", "?n"),), ()), Rule("b", (c("journey_count", "sql", "s", "2"), c("journey_since_ge", "build", "3")), ())]
    f = spark.createDataFrame([("journey_count", ["sql", "s", "2"]), ("journey_since_ge", ["build", "1"]), ("journey_seen", ["x", "s"])], "predicate string, args array<string>")
    assert {r.predicate: r.rules for r in journey.attributed(f, asked).collect()} == {"journey_count": ["a", "b"], "journey_since_ge": ["b"], "journey_seen": None}


def test_shell_text(spark):
    df = spark.createDataFrame([(1, 'git  push origin && echo "rm -rf x"'), (2, "cat <<EOF\nrm -rf x\nEOF\nls"), (3, "A=1 rm -rf y # rm"), (4, "echo 'git push'; true"), (5, None)], "id int, c string")
    hit = lambda w, code=True: {r.id for r in df.where(T.command_matches(F.col("c"), w, code)).collect()}
    assert hit("git push") == {1} and hit("rm -rf") == {3} and hit("rm -rf", False) == {2, 3} and hit("ls") == {2}
