import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rulelake.functions import text as T
from rulelake.functions import udf
from rulelake.model import Action, Condition, Rule
from rulelake.operators import audit, context, coverage, drift, graph, journey, outcomes, properties, scrub, stats
from rulelake.plans import tables

JOURNAL = "seq long, ts long, sid string, path string, module string, tags array<string>, subject string, kind string"


@pytest.fixture(scope="module")
def journal(spark):
    return spark.createDataFrame([
        (1, 1000, "s0", "a", "m", ["sql"], "x", None), (2, 1010, "s1", "b", "m", ["sql"], "x", None), (3, 1050, "s1", "b", "n", ["build"], "x", None),
        (4, 1060, "s1", "", None, ["lifecycle:prompt"], None, "prompt"), (5, 1090, "s1", "c", "n", ["sql"], "y", None), (6, 1095, "s1", "d", None, [], "y", None)], JOURNAL)


def test_journal_windows(journal):
    got = {(r.selector, r.window): r.n for r in journey.counts(journal, [("sql", "s"), ("sql", "2c"), ("sql", "1m"), ("module:n", "9c"), ("none", "1d")], "s1", 1100).collect()}
    assert got == {("sql", "s"): 2, ("sql", "2c"): 1, ("sql", "1m"): 1, ("module:n", "9c"): 2, ("none", "1d"): 0}
    assert [(r.selector, r.window) for r in journey.seen(journal, [("build", "1m"), ("build", "10s")], "s1", 1100).collect()] == [("build", "1m")]
    assert journey.distinct_paths(journal, "s", "s1", 1100).first().n == 3
    assert sorted(r.k for r in journey.since(journal, "build", 9).collect()) == [1, 2]
    assert [r.k for r in journey.since(journal, "build", 1).collect()] == [1] and journey.since(journal, "never", 5).collect() == []
    assert [r.k for r in journey.filtered_since(journal, "build", "sql", 9).collect()] == [1]
    assert sorted(r.seq for r in journey.occurrences(journal, "sql", "110s", "s1", 1100).collect()) == [1, 2, 5]
    assert [r.seq for r in journey.subject_tail(journal, "x", 2).collect()] == [2, 3]
    for bad in ("r", "5", "5x", "", "ss"):
        with pytest.raises(journey.WindowError):
            journey.parse_window(bad)
    with pytest.raises(journey.WindowError):
        journey.check_selectors(["sql", "nope"], ["sql"], [])
    journey.check_selectors(["sql", "module:n", "lifecycle:stop"], ["sql"], ["n"])


def test_facts_that_rules_ask_for(journal):
    c = lambda p, *a: Condition(p, a)
    rules = [Rule("a", (c("journey_count", "sql", "s", "?n"), c("journey_since_ge", "build", "2"), c("journey_since_ge", "build", "x")), (Action("log"),)),
             Rule("b", (c("journey_distinct", "path", "s", "3"), c("journey_filtered_since_ge", "build", "sql", "4"), c("journey_occurrence", "build", "s")), ())]
    got = sorted((r.predicate, *r.args) for r in journey.facts(journal, rules, "s1", 1100).collect())
    assert got == sorted([("journey_count", "sql", "s", "2"), ("journey_since_ge", "build", "1"), ("journey_since_ge", "build", "2"), ("journey_distinct", "path", "s", "3"),
                          ("journey_filtered_since_ge", "build", "sql", "1"), ("journey_occurrence", "build", "s", "3")])


def test_compaction_keeps_the_latest_signals(spark):
    r = random.Random(4)
    for _ in range(3):
        rows = [(i, i, "s", "", None, [f"signal:{r.choice('ab')}={r.choice('01')}"] if r.random() < 0.6 else [], r.choice(["x", "y", None]), "start" if r.random() < 0.1 else None) for i in range(60)]
        j = spark.createDataFrame(rows, JOURNAL)

        def latest(t):
            s = t.where("subject IS NOT NULL").select("subject", "seq", F.explode("tags").alias("t")).select(
                "subject", "seq", F.regexp_extract("t", "signal:(.)", 1).alias("key"), F.regexp_extract("t", "=(.)", 1).alias("status"))
            return sorted(map(tuple, outcomes.latest(s).collect()))

        small = journey.compacted(j, 5, 8)
        assert latest(small) == latest(j) and small.count() < 60
        assert small.where("kind IS NOT NULL").count() == j.where("kind IS NOT NULL").count()


def test_stops_pair_with_the_latest_open_start(spark):
    rows = [("s", 1, "start", "a"), ("s", 2, "start", "b"), ("s", 3, "start", "a"), ("s", 4, "stop", "a"), ("s", 5, "stop", None), ("s", 6, "stop", "z"), ("s", 7, "stop", None), ("t", 1, "stop", None)]
    got = {(r.sid, r.stop): r.start for r in journey.paired_stops(spark.createDataFrame(rows, "sid string, seq long, event string, agent string")).collect()}
    assert got == {("s", 4): 3, ("s", 5): 2, ("s", 6): None, ("s", 7): 1, ("t", 1): None}


def test_commits_and_in_flight(spark):
    runs = spark.createDataFrame([("r", 1, "h1", 0, "ls"), ("r", 2, "h2", 0, "git commit -m x"), ("r", 3, "h3", 1, "git commit"), ("r", 4, "h4", 0, "ls")], "repo string, seq long, head string, exit int, command string")
    assert [r.seq for r in journey.commits(runs).collect()] == [2]
    e = spark.createDataFrame([(1, 100), (2, 1000), (3, 2000)], "id int, ts long")
    assert sorted(r.id for r in journey.in_flight(e, 1000).collect()) == [1, 2, 3] and sorted(r.id for r in journey.in_flight(e, 1901).collect()) == [3]


EDGES = [("defines_fn", ["src/a.rs", "crate::a::f"]), ("defines_fn", ["src/b.rs", "crate::b::g"]), ("tested_by", ["crate::a::f", "t::one"]), ("tested_by", ["crate::a::f", "t::two"]),
         ("imports", ["crate::a", "crate::b"])]


def edges(spark, rows, d=False):
    return spark.createDataFrame([(i, p, a, "s", d) for i, (p, a) in enumerate(rows)], "ord long, p string, a array<string>, src string, d boolean")


def test_graph_queries(spark):
    e = edges(spark, EDGES)
    assert graph.query(e, "defines_fn", ["*", "g"]).count() == 1 and graph.query(e, "defines_fn", ["*", "b::g"]).count() == 1
    assert graph.query(e, "defines_fn", ["*", "?"]).count() == 0 and graph.query(e, "defines_fn", ["*", "*::?"]).count() == 2
    assert graph.query(e, "tested_by").count() == 2 and graph.query(e, "imports", ["*", "*", "*"]).count() == 0 and graph.query(e, "tested_by", limit=1).count() == 1
    assert graph.diagnose(e.limit(0), "x") == {"reason": "empty_graph"} and graph.diagnose(e, "test")["suggestions"] == ["tested_by"]
    assert graph.diagnose(e, "zzz")["suggestions"][:2] == ["defines_fn", "tested_by"] and graph.diagnose(e, "defines_fn", ["src", "*"])["samples"] == {0: ["src/a.rs", "src/b.rs"]}
    assert [r.fn for r in graph.no_direct_test(e).collect()] == ["crate::b::g"]


def test_suffix_rule_by_enumeration(spark):
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab:", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for want in ("a", "b:a", ":a", "::", "ab"):
        got = {r.w for r in df.where(T.names(F.col("w"), want)).collect()}
        assert got == {w for w in words if w == want or w.endswith(want) and (want[0] == ":" or w[-len(want) - 1] == ":")}


def test_cycles_and_closure_against_brute_force(spark):
    r = random.Random(2)
    for n in (6, 14):
        steps = {(str(r.randrange(n)), str(r.randrange(n))) for _ in range(n + 2)} | {("z", "z")}
        reach = set(steps)
        while more := {(a, d) for a, b in reach for c, d in steps if b == c} - reach:
            reach |= more
        df = spark.createDataFrame(sorted(steps), "x string, y string")
        got = {x.node: x.cycle for x in graph.cycles(df).collect()}
        nodes = {x for s in steps for x in s}
        assert got == {a: "cycle:" + "+".join(sorted(b for b in nodes if (a, b) in reach and (b, a) in reach)) for a in nodes if (a, a) in reach}
        starts = spark.createDataFrame([("0",), ("1",)], "start string")
        want = {(a, a) for a in "01"} | {(a, b) for a, b in reach if a in "01"}
        assert {(x.start, x.node) for x in graph.closure(starts, df).collect()} == want
        assert {(x.start, x.node) for x in graph.closure(starts, df, deep=True).collect()} == want
    stop = spark.createDataFrame([("2",)], "s string")
    line = spark.createDataFrame([("1", "2"), ("2", "3")], "x string, y string")
    assert {x.node for x in graph.closure(spark.createDataFrame([("1",)], "start string"), line, stop).collect()} == {"1", "2"}


def test_derived_relations(spark):
    rows = EDGES + [("file_type", ["src/a.rs", "production"]), ("defines_test", ["src/t.rs", "t::one"]), ("calls", ["t::one", "crate::a::f"]), ("calls", ["crate::a::f", "app::main"]), ("calls", ["app::main", "crate::b::g"]),
                    ("cargo_bin", ["app", "app", "app"]), ("declares_module", ["src/a.rs", "crate::a"]), ("generates", ["p", "x.json"]), ("deserializes", ["c", "y.json"])]
    e = edges(spark, rows)
    assert graph.no_direct_test(e).count() == 0  # only production files count
    assert {(r.test, r.fn) for r in graph.test_reaches(e).collect()} == {("t::one", x) for x in ("t::one", "crate::a::f", "app::main")}
    assert {(r.main, r.fn) for r in graph.bin_reaches(e).collect()} == {("app::main", "crate::b::g")}
    assert {(r.p, r.artifact) for r in graph.artifact_gaps(e).collect()} == {("generated_without_consumer", "x.json"), ("consumed_without_producer", "y.json")}
    assert [(r.kind, r.member, r.module) for r in graph.inventory(e).collect()] == [("function", "crate::a::f", "crate::a")]
    derived = graph.derive_all(e)
    assert {r.p for r in derived.collect()} == {"test_reaches", "bin_reaches", "data_flows_to", "generated_without_consumer", "consumed_without_producer"}


def test_callees_resolve_to_one_definition(spark):
    defs = spark.createDataFrame([("m::a::f", "m::a", None), ("m::b::f", "m::b", None), ("m::b::T::go", "m::b", "m::b::T"), ("m::c::U::go", "m::c", "m::c::U"), ("m::d::h", "m::d", None), ("m::e::h", "m::e", None)],
                                 "fn string, module string, owner string")
    calls = spark.createDataFrame([
        (1, "s", "m::a::x", "f", None, False), (2, "s", "m::z::x", "f", None, False), (3, "s", "m::q::x", "go", "T", True), (4, "s", "m::q::x", "go", None, True),
        (5, "s", "m::q::x", "h", None, False), (6, "s", "m::z::x", "m::b::f", None, False), (7, "s", "m::q::x", "nothing", None, False), (8, "s", "m::w::x", "f", None, False)],
        "edge int, src string, caller string, callee string, receiver string, is_method boolean")
    imports = spark.createDataFrame([("m::q", "m::b"), ("m::q", "m::c"), ("m::q", "m::d"), ("m::q", "m::e"), ("m::w", "m::facade")], "from string, to string")
    reexports = spark.createDataFrame([("m::facade", "m::b")], "module string, target string")
    got = {r.edge: (r.target, r.outcome) for r in graph.canonical_callees(calls, defs, imports, reexports).collect()}
    assert got == {1: ("m::a::f", "resolved"), 2: (None, "unresolved"), 3: ("m::b::T::go", "resolved"), 4: (None, "unresolved"), 5: (None, "ambiguous"),
                   6: ("m::b::f", "resolved"), 7: (None, "unresolved"), 8: ("m::b::f", "resolved")}
    stats_ = graph.resolution_stats(graph.canonical_callees(calls, defs, imports, reexports)).first()
    assert (stats_.unresolved, stats_.ambiguous) == (3, 1)


def test_packs_contracts_and_bindings(spark):
    refs = spark.createDataFrame([("s", "f", 1), ("s", "g", 2)], "scope string, name string, site int")
    decl = spark.createDataFrame([("s", "f", 10, "S::f"), ("s", "g", 11, "S::g"), ("s", "g", 12, "S::g2")], "scope string, name string, site int, symbol string")
    own = spark.createDataFrame([(1, "s", "t1", True), (2, "s", "c", False)], "site int, scope string, owner string, is_test boolean")
    assert [(r.p, r.a) for r in graph.pack_references(refs, decl, own).collect()] == [("tested_by", ["S::f", "t1"])]
    keys = spark.createDataFrame([("x", "k1"), ("x", "k2")], "artifact string, key string")
    cons = spark.createDataFrame([("x", "c", False, False), ("x", "d", True, False)], "artifact string, consumer string, flatten boolean, deny boolean")
    fields = spark.createDataFrame([("c", "k1")], "consumer string, field string")
    assert sorted((r.relation, r.key, r.consumer) for r in graph.data_contracts(keys, cons, fields).collect()) == [("maps_data_key", "k1", "c"), ("unconsumed_data_key", "k2", "c")]
    b = spark.createDataFrame([("r", "f", ["a", "b"], None), ("r", "g", ["a"], 5), ("q", "h", ["a"], None)], "rule string, symbol string, bound_to array<string>, stale_at int")
    d = spark.createDataFrame([("f", "b"), ("f", "c"), ("h", "z")], "symbol string, path string")
    got = {r.symbol: (r.state, r.surviving, r.relocated, r.stale_at) for r in graph.reconcile(b, d, 9).collect()}
    assert got == {"f": ("bound", ["b"], ["c"], None), "g": ("stale", [], [], 5), "h": ("moved", [], ["z"], None)}


def test_statistics(spark):
    vals = spark.createDataFrame([("a", 10), ("a", 220), ("b", 1), ("b", 2), ("b", 9)], "k string, v long")
    assert {r.k: r.median for r in stats.integer_median(vals, "v", ["k"]).collect()} == {"a": 115, "b": 2} and stats.integer_median(vals, "v").first().median == 9
    seven = spark.createDataFrame([(i,) for i in range(1, 8)], "v long")
    assert tuple(stats.nearest_rank(seven, "v").first()) == (4, 7) and tuple(stats.distribution(seven.limit(0), "v").first()) == (0, 0, 0, 0)
    fires = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "rule string, n long")
    assert {r.rule: r.n for r in stats.capped(fires, "rule", "n", 2).collect()} == {"a": 5, "b": 3, "__other__": 4}
    hist = {r.le: r.n for r in stats.histogram(seven, "v", buckets=4).collect()}
    assert hist == {"1.0": 1, "2.0": 2, "4.0": 4, "8.0": 7, "+Inf": 7}
    snaps = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 2), (1, "b", 1), (3, "b", 4), (2, "c", None)], "snapshot int, rule_id string, hits long")
    assert [tuple(r) for r in stats.trend(snaps).collect()] == [("a", 5, 2, 2, -3), ("b", 1, 4, 2, 3)]
    assert stats.filled(snaps, snaps, snaps).count() == 9
    line = stats.exposition(spark.createDataFrame([('a"b\\c', 3)], "l string, n long"), "f", ["l"], "n").first().line
    assert line == 'f{l="a\\"b\\\\c"} 3'


def test_outcomes(spark):
    runs = spark.createDataFrame([(1, "pytest -q", "3 passed, 2 failed", None), (2, "cargo test", "test result: ok. 2 passed; 0 failed\ntest result: ok. 5 passed; 0 failed", 0), (3, "make", "x", None),
                                  (4, "make all", "make: *** [x] Error 1", 0), (5, "ls", "", 0), (6, "cargo build", "", 101)], "subject int, command string, output string, command_exit int")
    got = {r.subject: (r.tool, r.outcome, r.passed, r.failed) for r in outcomes.evaluate(runs).collect()}
    assert got == {1: ("pytest", "fail", 3, 2), 2: ("cargo-test", "pass", 7, 0), 3: ("make", "unknown", None, None), 4: ("make", "fail", None, None), 6: ("cargo-build", "fail", None, None)}
    over = outcomes.registry(outcomes.BUILTIN, [outcomes.Toolchain("make", "^mk")])
    assert [t.id for t in over] == [t.id for t in outcomes.BUILTIN] and over[3].command == "^mk"
    res = spark.createDataFrame([("s", "a", "pass", 1), ("s", "b", "pass", 2), ("s", "a", "pass", 4)], "subject string, key string, status string, seq int")
    mark = spark.createDataFrame([("s", 3)], "subject string, seq int")
    assert tuple(outcomes.proofs(res, mark).first())[1:] == (1, 2, False) and outcomes.proofs(res, mark.limit(0)).first().holds
    bugs = spark.createDataFrame([("b1", "t1", "open"), ("b2", "t2", "open"), ("b3", "t9", "open"), ("b4", "t1", "closed")], "bug_id string, test string, status string")
    tests = spark.createDataFrame([("t1", True), ("t2", False), ("t3", False)], "name string, passed boolean")
    assert {r.bug_id: (r.outcome, r.regression) for r in outcomes.bug_checks(bugs, tests).collect()} == {"b1": ("fixed", True), "b2": ("open", True), "b3": ("unknown", True)}


def test_audit(spark):
    files = spark.createDataFrame([("src/a.rs", "aXbXcX\nno\n/// doc\n#[x]\n\nX"), ("t/b.py", "X")], "file string, text string")
    rules = spark.createDataFrame([("r", "warn", "X", None, "rs", None), ("big", "block", None, None, None, 3), ("p", "block", "X", "t/", None, None)],
                                  "rule_id string, level string, needle string, path_part string, ext string, min_lines int")
    got = sorted((r.rule_id, r.file, r.line_no, r.k) for r in audit.hits(files, rules).collect())
    assert got == [("big", "src/a.rs", 1, 1), ("p", "t/b.py", 1, 1), *[("r", "src/a.rs", 1, k) for k in (1, 2, 3)], ("r", "src/a.rs", 6, 1)]
    kept = audit.not_documented(audit.hits(files, rules).where("rule_id = 'r'"), audit.lines(files))
    assert {r.line_no for r in kept.collect()} == {1}
    roll = audit.rollup(audit.hit_counts(files, rules)).collect()
    assert [(r.rule_id, r.hits, r.files) for r in roll] == [("big", 1, 1), ("p", 1, 1), ("r", 4, 1)]
    f = spark.createDataFrame([("a", "fn", ["a", "x"]), ("a", "un", ["a"]), ("b", "fn", ["b", "y"])], "file string, predicate string, args array<string>")
    assert audit.union_rule(f, [("fn", ("?f", "?n")), ("un", ("?f",))]).count() == 2
    assert audit.not_exempt(audit.hits(files, rules), spark.createDataFrame([("src/a.rs", "r")], "file string, rule_id string")).count() == 2


def test_detection_and_placeholders(spark):
    texts = ["password = hunter2hunter2", "password: swordfishes", "mail a.b@example.org now", "-----BEGIN RSA PRIVATE KEY-----", "see https://host/Users/x /home/me/p ./rel/path /usr/lib/x file:///Users/a", "postgres://u:pw@h", None,
             "Bearer abcdefghijklmnop1", "MY_API_KEY=abcd1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.what, r.severity) for r in scrub.findings(df).collect())
    assert got == sorted([(0, "token/secret assignment", "error"), (1, "token/secret assignment", "warning"), (2, "email address", "warning"), (3, "private-key header", "error"),
                          (4, "absolute path outside the project placeholder roots", "error"), (4, "absolute path outside the project placeholder roots", "error"), (5, "credential-bearing URL", "error"),
                          (7, "bearer token", "error"), (8, "secret-suggesting environment key", "error")])
    one = scrub.placeholders(spark.createDataFrame([(1, "/a/b /a/b/c /a/b")], "id int, text string"), "id").first().text
    assert one == "<PATH_1> <PATH_2> <PATH_1>"
    r = random.Random(1)
    paths = ["/" + "/".join("".join(r.choices("abXY09._-", k=r.randint(1, 8))) for _ in range(r.randint(2, 5))) for _ in range(200)]
    left = scrub.placeholders(spark.createDataFrame([(i, f"x {p} y") for i, p in enumerate(paths)], "id int, text string"), "id").collect()
    assert all(p not in x.text for x, p in zip(sorted(left, key=lambda x: x.id), paths))


def test_drift(spark):
    rules = spark.createDataFrame([("r1", 0, "never unwrap results in library code"), ("r2", 1, "cargo test before commit"), ("r3", 2, "never unwrap results in library code")], "target string, ord int, text string")
    notes = spark.createDataFrame([("n1", "feedback", "unwrap", "never unwrap results, see src/lib"), ("n2", "feedback", "patience", "builds take long"), ("n3", "user", "likes", "git commit often"),
                                   ("n4", "project", "test", "run cargo test first")], "id string, kind string, description string, body string")
    got = {r.id: (r.bucket, r.covered, r.target) for r in drift.notes(notes, rules).collect()}
    assert got == {"n1": ("actionable", True, "r1"), "n2": ("ambient", False, None), "n3": ("personal", False, None) if not got["n3"][1] else ("personal", True, "r2"), "n4": ("actionable", True, "r2")}
    pages = spark.createDataFrame([("d1", "superseded", [], "x"), ("d2", "accepted", ["r2"], "zzz"), ("d3", "accepted", [], "never unwrap results"), ("d4", "proposed", ["gone"], "qqq")], "id string, status string, enforces array<string>, text string")
    assert {r.id: (r.state, r.target, round(r.similarity, 2)) for r in drift.decisions(pages, rules).collect()} == {"d2": ("covered", "r2", 1.0), "d3": ("likely", "r1", 0.6), "d4": ("uncovered", None, 0.0)}
    items = spark.createDataFrame([("a", True, 0), ("b", True, 1), ("b", False, 2), ("a", False, 3)], "family string, personal boolean, ord int")
    assert [r.ord for r in drift.triage(items, 3).collect()] == [2, 1, 3]


def test_coverage(spark):
    hits = spark.createDataFrame([("t", "r1", "ABC", "x"), ("t", "r1", "abc", "x"), ("u", "file:f", "abc", "x")], "test string, region string, revision string, tool string")
    assert coverage.validated(hits).count() == 2
    with pytest.raises(Exception, match="several tools"):
        coverage.validated(hits.withColumn("tool", F.col("test"))).collect()
    r = random.Random(3)
    lines = [(f"f{r.randrange(3)}", r.randrange(1500)) for _ in range(200)]
    spans = [(f"f{r.randrange(3)}", f"r{i}", s, s + r.choice([0, 5, 700])) for i in range(60) for s in [r.randrange(1500)]]
    got = coverage.lines_in_spans(spark.createDataFrame(lines, "file string, line long"), spark.createDataFrame(spans, "file string, region string, start long, end long")).count()
    assert got == sum(a == f and s <= n <= e for a, n in lines for f, _, s, e in spans)
    changed = spark.createDataFrame([("r1", "g"), ("r2", "f")], "region string, file string")
    dyn = coverage.select_dynamic(changed, hits.drop("tool"))
    assert {tuple(x) for x in dyn.collect()} == {("t", "r1"), ("u", "r2")}
    assert [x.region for x in coverage.gaps(changed.union(changed), hits).collect()] == ["r2"] and coverage.gaps(changed, hits, False).count() == 2
    fns = spark.createDataFrame([("a.rs", "go", "reg")], "file string, leaf string, region string")
    reach = spark.createDataFrame([("t1", "m::go"), ("t2", "app::main")], "test string, fn string")
    static = coverage.select_static(fns, reach, spark.createDataFrame([("app::main", "m::go")], "main string, fn string"), spark.createDataFrame([("a.rs", "m::go")], "file string, fn string"))
    assert {x.test for x in static.collect()} == {"t1", "t2"} and coverage.select_tests(dyn, static).count() == 4


def test_changed_lines_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("\n".join(r.choices("xyz", k=r.randint(0, 9))) for _ in range(2))
        x, y = a.split("\n"), b.split("\n")
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(coverage.changed_lines(a, b)) == len(y) - best[-1][-1]
    assert coverage.changed_lines("a\nb\nc", "a\nX\nc") == [2] and coverage.changed_lines("a\nb", "q\nr", most_cells=1) == [1, 2]


def test_properties(spark):
    props = spark.createDataFrame([("p", "safety", "accepted", ["r1"], ["e"]), ("q", "safety", "accepted", ["r2"], [])], "id string, kind string, status string, depends_on array<string>, encodings array<string>")
    good, sha = "a" * 40, "b" * 64
    res = spark.createDataFrame([(2, "p", "v", "pass", good, "proof", sha), (1, "p", "v", "pass", good, "proof", sha), (2, "p", "v", "pass", None, "proof", sha), (2, "p", "v", "pass", "zz", "proof", sha), (2, "p", "v", "pass", good, None, sha),
                                 (2, "p", "v", "pass", good, "guess", sha), (2, "p", "v", "pass", good, "test", None), (2, "p", "v", "pass", good, "test", "x"), (2, "z", "v", "pass", good, "test", sha), (2, "q", "v", "pass", good, "test", sha),
                                 (2, "p", "w", "pass", good, "test", "c" * 64)], "v int, property string, verifier string, status string, revision string, tier string, artifact_sha256 string")
    allowed = spark.createDataFrame([(sha,)], "artifact_sha256 string")
    want = [None, "legacy_record", "missing_revision", "invalid_revision", "missing_tier", "invalid_tier", "missing_artifact", "invalid_artifact", "unknown_property", "no_encoding", "artifact_not_approved"]
    assert sorted(map(str, (r.reason for r in properties.bind(res, props, allowed).collect()))) == sorted(map(str, want))
    assert properties.bind(res.limit(1), props, None).first().reason == "allowlist_unreadable"
    changed = spark.createDataFrame([("r1",)], "region string")
    assert [r.id for r in properties.obligations(props, res, changed, "f" * 40).collect()] == ["p"] and properties.obligations(props, res, changed, good).count() == 0
    assert {r.property for r in properties.stale(props, res, changed, "f" * 40).collect()} == {"p"}
    after, log = properties.transition(props, "p", "retired", "moved", 7)
    assert {r.id: r.status for r in after.collect()} == {"p": "retired", "q": "accepted"} and log.first().was == "accepted"
    with pytest.raises(ValueError):
        properties.transition(props, "p", "retired", " ", 7)


def test_packing_is_greedy(spark):
    assert context.admit([("a", 60, None), ("a", 50, None), ("b", 30, None), ("b", 9, 8)], 100, 100, {}) == [None, "byte_capacity", None, "kind_ceiling"]
    assert context.admit([("a", 10, None)] * 3, 100, 100, {"a": 20}) == [None, None, None]  # what is left goes to those over their ceiling
    assert context.admit([("a", 10, None)] * 3 + [("b", 80, None)], 100, 100, {"a": 20}) == [None, None, "byte_capacity", None]
    assert context.admit([("a", 30, None), ("nudge", 60, None), ("a", 30, None)], 100, None, {"a": 40}) == [None, None, "displaced_by_nudge"]
    assert context.admit([("rule", 500, None), ("a", 30, None)], 600, None, {}) == [None, None]
    assert context.admit([("a", 10, None)], 100, 3, {}) == ["token_capacity"]
    items = spark.createDataFrame([("g", 1, "k", "i1", "x" * 60, None), ("g", 2, "k", "i2", "x" * 50, None), ("g", 3, "k", "i3", "é" * 15, None), ("h", 1, "k", "i4", "x" * 99, None)],
                                  "group string, ord int, kind string, stable_id string, body string, max_bytes long")
    assert {r.stable_id for r in context.pack(items, 100, 100).where("admitted").collect()} == {"i1", "i3", "i4"}


def test_capsules(spark):
    c = spark.createDataFrame([("a", "session", "s", None, None, False, None, 5, 2), ("b", "persistent", "x", None, None, False, None, 9, 1), ("c", "session", "s", 9, None, False, None, 1, 1), ("d", "session", "s", None, 11, False, None, 1, 1),
                               ("e", "session", "s", None, None, True, None, 1, 1), ("f", "next_interaction", "s", 10, 10, False, "t", 5, 1)],
                              "id string, lifecycle string, session_id string, expires_at long, lease_until long, acknowledged boolean, lease_token string, priority int, emitted_at int")
    ok = context.eligible(c, "s", 10)
    assert [r.id for r in context.capsule_order(ok).collect()] == ["b", "f", "a"]
    held = context.leased(c, ok.select("id"), "tok", 99)
    assert context.eligible(held, "s", 50).count() == 1  # d's own lease has ended
    done = context.acknowledged(held, "tok")
    assert {r.id: r.acknowledged for r in done.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": True}
    one = lambda i, by="r", body="x", p=0: {"id": i, "emitted_by": by, "body": body, "priority": p}
    assert context.emit([one("a")], [one("a"), one("a", "q"), one("b", body="x" * 9000)]) == [("a", "replaced"), ("a", "owner_conflict"), ("b", "record_too_large")]
    full = [one(f"c{i}") for i in range(context.MAX_CAPSULES - context.RESERVED)]
    assert context.emit(full, [one("n"), one("u", p=50)]) == [("n", "no_slot"), ("u", "stored")]


def test_scalar_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert [row(T.seconds(lit(x))) for x in ("30m", "24h", "7d", "2w", "9s", "x", "5y")] == [1800, 86400, 604800, 1209600, 9, None, None]
    assert row(T.segments(lit("A=1 B=2 git add -A && ls | wc; # c\ncargo test"))) == ["git add -A", "ls", "wc", "cargo test"]
    assert row(T.normalised_path(lit("./a//b/../c/./d/"))) == "a/c/d" and row(T.normalised_path(lit("/x\\y/../../.."))) == "/.."
    assert row(T.shown(lit("abcdefghijklmnop"))) == "abcdefghijkl…[4 more chars redacted]" and row(T.shown(lit("abc"))) == "abc"
    assert row(T.shortened(lit("abcdef"), 3)) == "abc…" and row(T.leaf(lit("a::b::c"))) == "c"
    assert row(T.excerpt(lit("x" * 30 + "HIT" + "y" * 30), lit(30), lit(3))) == "x" * 20 + "HIT" + "y" * 20
    assert row(T.fact_id(lit("n"), lit("p:q"), F.array(lit("a%"), lit("b")), lit(0))) == "n:p%3Aq:a%25:b" and row(T.fact_id(lit("n"), lit("p"), F.array(lit("a")), lit(2))) == "n:p:a#2"
    assert sorted(row(T.tokens(lit("The Größe of X, größe! ab a")))) == ["ab", "größe"] and row(T.occurrences(lit("aXbXcX"), lit("X"))) == 3
    assert [row(T.humanised(lit(n))) for n in (5, 65, 7300, 200000)] == ["5s", "1m", "2h", "2d"]
    c = T.clock(F.lit(dt.datetime(2024, 1, 5, 9, 0)).cast("timestamp"))
    assert [row(v) for v in c.values()] == ["friday", "9", "true"]
    assert row(T.path_glob(lit("src/a/b.rs"), "src/**")) and not row(T.path_glob(lit("src/a/b.rs"), "src/*")) and row(T.glob(lit("abc"), "a?c"))


def test_python_surfaces(spark):
    def provider(event, emit):
        if event["n"] < 0:
            emit("__secret", [1])
        for i in range(event["n"]):
            emit("number", [event["n"], i])

    rows = udf.provide(spark.createDataFrame([("a", 2), ("b", -1), ("c", 200), ("d", 0)], "id string, n int"), provider).collect()
    assert sum(r.predicate == "number" for r in rows if r.key == "a") == 2 and all(r.error and "reserved" in r.error for r in rows if r.key == "b")
    assert [r.error is not None for r in rows if r.key == "c"] == [True]
    spark.udtf.register("numbers", udf.udtf_of(provider))
    assert [tuple(r.args) for r in spark.sql("""SELECT args FROM numbers('{"n": 2}')""").collect()] == [("2", "0"), ("2", "1")]
    t = spark.createDataFrame([("a", "x")], "k string, v string")
    asked = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r.k: r.v for r in udf.lookup(asked, t, ["k"]).collect()} == {"a": "x", "b": None}
    with pytest.raises(Exception, match="without an entry"):
        udf.lookup(asked, t, ["k"], strict=True).collect()
    assert spark.createDataFrame([("w", None)], "a string, b string").select(udf.template("{a}-{b}-{c}", ["a", "b"]).alias("t")).first().t == "w--{c}"
    assert tables.cut(t).collect() == t.collect()


def test_many_needles_equal_few(spark, monkeypatch):
    import random

    from rulelake.operators import needles

    r = random.Random(8)
    text = lambda n: "".join(r.choice("aab b\n🙂ä") for _ in range(n))
    rows = [(f"d{i % 3}/f{i}.{r.choice(['rs', 'py'])}", r.choice([text(40), text(400), "", None, text(5)])) for i in range(40)]
    files = spark.createDataFrame(rows, "file string, text string").repartition(3)
    words = ["a", "aa", "aba", "b b", "🙂", "🙂ä", "a\nb", "", None, "zz", "aa", "ä"] + [text(3) for _ in range(40)]
    made = [(f"r{i}", r.choice(["warn", "block"]), w, r.choice([None, None, "d1/"]), r.choice([None, None, "rs"]), r.choice([None, None, 3])) for i, w in enumerate(words)]
    rules = spark.createDataFrame(made, "rule_id string, level string, needle string, path_part string, ext string, min_lines int")
    want_lines, want_counts = [], []
    for file, t in rows:
        for rule, level, w, part, ext, least in made:
            if part and part not in file or ext and not file.endswith("." + ext) or least is not None and (t is None or t.count("\n") + 1 <= least):
                continue
            if w is None:
                want_lines.append((file, rule, level, 1, 1))
                want_counts.append((rule, level, file, 1))
            elif w and "\n" not in w and t is not None and w in t:
                want_counts.append((rule, level, file, t.count(w)))
                want_lines += [(file, rule, level, n, k + 1) for n, line in enumerate(t.split("\n"), 1) for k in range(line.count(w))]
    for few in (needles.FEW, 100):
        monkeypatch.setattr(needles, "FEW", few)
        assert sorted(map(tuple, audit.hit_counts(files, rules).collect())) == sorted(want_counts)
        assert sorted(map(tuple, audit.hits(files, rules).collect())) == sorted(want_lines)
        some = [w for w in words if w is not None]
        told = {(f, p) for f, p in map(tuple, audit.containing(files, some).collect())}
        assert told == {(f, w) for f, t in rows if t is not None for w in some if w in t}
        assert {(f, p) for f, p in map(tuple, audit.missing(files, some).collect())} == {(f, w) for f, t in rows if t is not None for w in some if w not in t}


def test_long_chains_and_rings_take_logarithmic_rounds(spark, monkeypatch):
    from rulelake.plans import tables

    rounds, become = [], tables.Held.become
    monkeypatch.setattr(tables.Held, "become", lambda self, df: rounds.append(1) or become(self, df))
    n = 1000
    at = lambda i: f"n{i * 7919 % n:04}"
    ring = spark.createDataFrame([(at(i), at(i + 1)) for i in range(n)] + [("tail", at(5)), (at(9), "out"), ("out", "end"), ("self", "self")], "x string, y string")
    sizes = graph.cycles(ring).groupBy("cycle").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, n] and len(rounds) < 45
    rounds.clear()
    path = spark.createDataFrame([(at(i), at(i + 1)) for i in range(n - 1)], "x string, y string")
    assert graph.cycles(path).count() == 0 and len(rounds) < 20
    rounds.clear()
    starts = spark.createDataFrame([(at(0),), (at(n - 10),)], "start string")
    assert {r.start: r["count"] for r in graph.closure(starts, path, deep=True).groupBy("start").count().collect()} == {at(0): n, at(n - 10): 10} and len(rounds) < 40


def test_many_starts_share_rows(spark):
    edges = spark.createDataFrame([(f"t{i}", f"f{i % 7}") for i in range(200)] + [("f1", "g"), ("g", "h"), ("f2", "g")], "x string, y string")
    stop = spark.createDataFrame([("g",)], "node string")
    got = {(r.start, r.node) for r in graph.closure(edges.where("x LIKE 't%'").select(graph.F.col("x").alias("start")), edges, stop).collect()}
    assert got == {(f"t{i}", f"t{i}") for i in range(200)} | {(f"t{i}", f"f{i % 7}") for i in range(200)} | {(f"t{i}", "g") for i in range(200) if i % 7 in (1, 2)}


def test_best_matches_against_all_pairs(spark):
    import random

    from rulelake.functions.text import tokens
    from rulelake.operators import drift

    r = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(["common", "shared"] + r.sample(vocab, n))
    right = [(f"t{i}", i, text(r.choice([0, 2, 5, 9, 20]))) for i in range(25)] + [("same", 30, "common shared"), ("empty", 31, "")]
    left = [(f"l{i}", text(r.choice([0, 1, 4, 8, 15]))) for i in range(40)] + [("copy", right[3][2]), ("none", "nothing alike"), ("null", None)]
    a, b = spark.createDataFrame(left, "id string, text string"), spark.createDataFrame(right, "target string, ord long, text string")
    sets = {x.text: set(x.t) for x in a.select("text").union(b.select("text")).distinct().select("text", tokens(graph.F.col("text")).alias("t")).collect() if x.text is not None}
    for least in (0, 14, 60):
        want = {}
        for i, t in left:
            scores = [(len(sets[t] & sets[u]) / len(sets[t] | sets[u]), -o, j) for j, o, u in right if t is not None and sets[t] & sets[u]]
            scores = [s for s in scores if s[0] * 100 >= least - 1e-9]
            if scores:
                want[i] = max(scores)[2]
        assert {x.id: x.target for x in drift.best_match(a, b, least=least).collect()} == want


def test_long_spans_are_few_rows(spark):
    import random

    r = random.Random(1)
    spans = [("f", a, a + r.choice([0, 5, 255, 256, 1000, 10_000_000])) for a in [r.randrange(0, 20_000_000) for _ in range(60)]] + [("f", 9, 8), ("g", 0, 1 << 40), ("f", None, 4)]
    lines = [(r.choice("fg"), r.randrange(0, 21_000_000)) for _ in range(400)] + [("f", x) for _, a, b in spans[:60] for x in (a - 1, a, b, b + 1)]
    s = spark.createDataFrame(spans, "file string, start long, end long")
    got = sorted((x.file, x.line, x.start, x.end) for x in coverage.lines_in_spans(spark.createDataFrame(lines, "file string, line long"), s).collect())
    assert got == sorted((f, n, a, b) for f, n in lines for g, a, b in spans if f == g and a is not None and a <= n <= b)
    sizes = s.where("start IS NOT NULL").select(graph.F.size(coverage.nodes(graph.F.col("start"), graph.F.col("end"))).alias("n")).collect()
    assert max(x.n for x in sizes) < 64 and max(x.n for x, (f, a, b) in zip(sizes, [x for x in spans if x[1] is not None]) if b - a <= 10_000_000) < 50


def test_ranks_by_digits_against_sorting(spark):
    import random

    from rulelake.operators.ranks import at_ranks

    r = random.Random(3)
    draws = [lambda: r.randint(-5, 5), lambda: r.choice([-(1 << 63), (1 << 63) - 1, 0, 7]), lambda: r.randint(-(1 << 40), 1 << 40), lambda: 9, lambda: r.choice([1, 70_000, 70_001, None])]
    for draw in draws:
        rows = [(r.choice(["a", "b", None]), draw()) for _ in range(300)] + [("gone", None)]
        df = spark.createDataFrame(rows, "k string, v long")
        got = {x.k: (x.p1, x.p50, x.p95, x.p100) for x in stats.nearest_rank(df, "v", [1, 50, 95, 100], ["k"]).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            own = sorted(v for g, v in rows if g == k and v is not None)
            want[k] = tuple(own[max(1, -(-len(own) * p // 100)) - 1] if own else 0 for p in (1, 50, 95, 100))
        assert got == want
    assert at_ranks(df.limit(0), "v", {"m": graph.F.lit(1)}, ["k"]).collect() == [] and at_ranks(df.limit(0), "v", {"m": graph.F.lit(1)}).first().m is None


def test_long_sessions_are_spread(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice(["s", "s", "s", "t", None]), i, r.choice(["prompt", "stop", "interrupt", "tool", "session_end"]), r.choice([None, None, "a"]), r.choice([True, False, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "sid string, seq long, event string, agent string, interrupted boolean").repartition(5)
    one, many = (sorted(map(tuple, journey.prompt_class(df, n).collect()), key=repr) for n in (10_000, 50))
    assert one == many and len(one) > 50


def test_many_windows_against_one_by_one(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.randint(0, 5000), r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.choice([["t"], ["t", "u"], [], None]), r.choice([None, None, "stop"])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, ts long, sid string, module string, tags array<string>, kind string").repartition(3)
    asked = [(k, r.choice(["t", "u", "module:x", "nothing"]), r.choice(["s", "10c", "500c", "0c", "90s", "20m", "1h", "0s"]), r.choice(["a", "zz"]), r.choice([0, 1000, 5000, 9000])) for k in range(60)]
    got = {x.k: x.n for x in journey.many_counts(df, spark.createDataFrame(asked, "k int, selector string, window string, sid string, now long")).collect()}
    tools_ = sorted(i for i, row in enumerate(rows) if row[5] is None)
    for k, selector, token, sid, now in asked:
        kind, n = journey.parse_window(token)
        own = [i for i, row in enumerate(rows) if (row[3] == selector[7:] if selector.startswith("module:") else row[4] is not None and selector in row[4])]
        inside = set(tools_[max(0, len(tools_) - n):]) if kind == "calls" else {i for i, row in enumerate(rows) if (row[1] + n >= now if kind == "seconds" else row[2] == sid)}
        assert got[k] == len(inside & set(own)), (selector, token, sid, now)
    assert journey.many_counts(df.limit(0), spark.createDataFrame(asked, "k int, selector string, window string, sid string, now long")).agg(graph.F.sum("n")).first()[0] == 0
