"""Steps that hold for tables of any size, each against a plain computation."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_needles_beyond_one_automaton(spark, monkeypatch):
    import random

    from rulelake.operators import audit, needles

    monkeypatch.setattr(needles, "FEW", 1)
    monkeypatch.setattr(needles, "MOST", 20)
    r = random.Random(8)
    text = lambda n: "".join(r.choice("aab b\n🙂ä") for _ in range(n))
    rows = [(f"f{i}.{r.choice(['rs', 'py'])}", r.choice([text(40), text(400), "", None])) for i in range(40)]
    words = ["a", "aa", "aba", "🙂", "🙂ä", "a\nb", "", "zz", "aa"] + [text(n) for n in (2, 3, 7) for _ in range(20)]
    made = [(f"r{i}", "warn", w, None, r.choice([None, "rs"]), r.choice([None, 3])) for i, w in enumerate(words)]
    rules = spark.createDataFrame(made, "rule_id string, level string, needle string, path_part string, ext string, min_lines int")
    files = spark.createDataFrame(rows, "file string, text string").repartition(3)
    counts, lines = [], []
    for file, t in rows:
        for rule, level, w, _, ext, least in made:
            if t is None or not w or "\n" in w or w not in t or ext and not file.endswith(ext) or least and t.count("\n") + 1 <= least:
                continue
            counts.append((rule, level, file, t.count(w)))
            lines += [(file, rule, n) for n, line in enumerate(t.split("\n"), 1) for _ in range(line.count(w))]
    assert sorted(map(tuple, audit.hit_counts(files, rules).collect())) == sorted(counts)
    assert sorted(map(tuple, audit.hits(files, rules).select("file", "rule_id", "line_no").collect())) == sorted(lines)


def test_callees_of_a_common_name_are_not_all_compared(spark):
    import re

    from rulelake.operators import graph

    calls = spark.createDataFrame([(i, "f", f"p{i}::m::T::x", "go", "T", True) for i in range(30)] + [(100 + i, "f", f"p{i}::m::x", "go", None, False) for i in range(30)],
                                  "edge int, src string, caller string, callee string, receiver string, is_method boolean")
    fns = spark.createDataFrame([(f"p{i}::m::T::go", f"p{i}::m", f"p{i}::m::T") for i in range(30)] + [(f"p{i}::go", f"p{i}", None) for i in range(30)], "fn string, module string, owner string")
    told = graph.canonical_callees(calls, fns, spark.createDataFrame([], "from string, to string"))
    want = {i: f"p{i}::m::T::go" for i in range(30)} | {100 + i: f"p{i}::go" for i in range(30)}
    assert {r.edge: r.target for r in told.collect()} == want
    joins = [line for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"\bJoin\b.*leaf#", line)]
    assert joins and all(line.count(" = ") > 1 for line in joins)


def test_covered_functions_are_told_once(spark, monkeypatch):
    import random

    from rulelake.operators import coverage

    r = random.Random(4)
    data = [(f"t{r.randrange(9)}", f"f{r.randrange(3)}", r.randrange(900), r.randrange(3)) for _ in range(300)]
    functions = [(f"f{i % 3}", None if i == 5 else f"n{i // 2 % 20}", s := 8 * r.randrange(100), s + r.choice([0, 3, 500, -1])) for i in range(80)]
    vetoed = [("t1", "f1", f"n{i}") for i in range(0, 20, 3)]
    want = {(t, f, n) for t, f, line, c in data if c for g, n, s, e in functions if f == g and s <= line <= e} - set(vetoed)
    asked, place = [], coverage.lines_in_spans
    monkeypatch.setattr(coverage, "lines_in_spans", lambda a, b: asked.append((a, b)) or place(a, b))
    got = coverage.lcov_hits(spark.createDataFrame(data, "test string, file string, line long, count int"), spark.createDataFrame(functions, "file string, name string, start long, end long"),
                             spark.createDataFrame(vetoed, "test string, file string, name string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    (lines, spans), = asked
    assert lines.count() == lines.select("file", "line").distinct().count() and spans.count() == len({(f, s, e) for f, _, s, e in functions})


def test_reach_is_told_after_the_join(spark):
    from rulelake.operators import graph

    steps = spark.createDataFrame([(f"t{i}", f"{'ab'[i % 2]}0") for i in range(150)] + [(f"{c}{i}", f"{c}{i + 1}") for c in "ab" for i in range(3)], "x string, y string")
    got = graph.closure(steps.where("x LIKE 't%'").select(F.col("x").alias("start")), steps)
    assert {(r.start, r.node) for r in got.collect()} == {(f"t{i}", f"t{i}") for i in range(150)} | {(f"t{i}", f"{'ab'[i % 2]}{k}") for i in range(150) for k in range(4)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # rows of bits are joined, not each start and node


def test_notes_without_a_subject_match_by_their_body(spark):
    """The words that mark a case's kind are not counted as words of its text."""
    import inspect

    from rulelake import catalog_wide
    from rulelake.functions.text import tokens
    from rulelake.operators import drift

    said = F.lit("to a.b")
    row = spark.range(1).select(drift.has_trigger(said).alias("hit"), F.size(tokens(said)).alias("n")).first()
    assert row.hit and row.n == 0 and '"to a.b"' in inspect.getsource(catalog_wide)


def test_best_matches_with_and_without_pairs(spark, monkeypatch):
    import random

    from rulelake.operators import drift
    from rulelake.plans import tables

    r = random.Random(16)
    text = lambda n: " ".join(r.choice(["common"] + [f"w{i}" for i in range(12)]) for _ in range(n))
    right = spark.createDataFrame([(f"t{i}", i, text(r.choice([0, 2, 6, 20]))) for i in range(30)], "target string, ord long, text string")
    left = spark.createDataFrame([(i, r.choice([text(3), text(9), "", None])) for i in range(60)], "id int, text string")
    counted = {least: sorted(map(tuple, drift.best_match(left, right, least=least).collect())) for least in (0, 14, 60)}
    one_pass = drift.best_match(left, right)
    assert "MapInArrow" in one_pass._jdf.queryExecution().optimizedPlan().toString() and len(counted[0]) > len(counted[60]) > 0
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    for least, want in counted.items():
        assert sorted(map(tuple, drift.best_match(left, right, least=least).collect())) == want


def test_stores_are_rows_not_groups_of_frames(spark):
    import random

    from rulelake.operators import context

    r = random.Random(3)
    held = [(s, f"c{i}", r.choice("ab"), r.randrange(9000)) for s in (0, 1, 2, 9) for i in range(r.randrange(40))]
    new = [(s, o, f"c{r.randrange(60)}", r.choice("ab"), r.randrange(9000), r.choice([10, 90])) for s in range(5) for o in range(40)]
    new += [(None, 1, "c1", "a", 5, 10)]
    want = []
    for s in {n[0] for n in new}:
        one = lambda i, by, size, *p: {"id": i, "emitted_by": by, "body": "x" * size, "priority": p[0] if p else None}
        mine = sorted(n[1:] for n in new if n[0] == s)
        want += [(s, n[0], i, o) for n, (i, o) in zip(mine, context.emit([one(*h[1:]) for h in held if h[0] == s], [one(*n[1:]) for n in mine]))]
    got = context.emitted(spark.createDataFrame(held, "store int, id string, emitted_by string, size long"),
                          spark.createDataFrame(new, "store int, ord int, id string, emitted_by string, size long, priority int"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_changes_of_sets_take_one_shuffle(spark):
    from rulelake.operators import coverage

    old = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (None, 1)], "k int, i int")
    new = spark.createDataFrame([(1, 2), (1, 3), (3, None), (None, 1)], "k int, i int")
    got = coverage.set_changes(old, new, "k", "i")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, 1, "removed"), (2, 1, "removed"), (1, 3, "added"), (3, None, "added")]))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_union_rule_reads_facts_once(spark):
    from rulelake.operators import audit

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf
    rows = [("a", "p", ["x"]), ("a", "q", ["y", "z"]), ("b", "p", ["x"]), ("c", "q", ["n", "z"]), ("c", "p", ["x"])]
    facts = spark.createDataFrame(rows, "file string, predicate string, args array<string>").mapInPandas(counted, "file string, predicate string, args array<string>")
    got = audit.union_rule(facts, [("p", ["?x"]), ("q", ["y", "?z"])]).select("file", "predicate", "condition")
    assert sorted(map(tuple, got.collect())) == [("a", "p", 0), ("a", "q", 1)]
    assert reads.value == len(rows)


def test_source_files_are_dealt_out_to_all_cores(spark):
    from rulelake import catalog_wide

    assert catalog_wide.sources_of(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_reports_are_read_by_the_line(spark):
    from rulelake import catalog
    from rulelake.sources import files

    text = "TN:a\r\nSF:x\nDA:3,2,h\nnoise\n\nend_of_record\nSF:y\nFNDA:1,go\nDA:4,0\nend_of_record\nDA:5,1"
    want = [("r", 0, "a", "x", "DA", None, 3, 2), ("r", 1, None, "y", "DA", None, 4, 0), ("r", 1, None, "y", "FNDA", "go", None, 1), ("r", 2, None, None, "DA", None, 5, 1)]
    got = files.lcov(spark.createDataFrame([("r", text)], "report string, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    for name in ("s11_lcov", "n6_section_ids"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Window" in plan  # no report is one value


def test_pairs_of_one_relation_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from rulelake.model import Condition, Rule
    from rulelake.operators import facts
    from rulelake.plans import rules

    rows = spark.range(1500).coalesce(1).select("id", F.when(F.col("id") < 1200, 0).when(F.col("id") < 1499, F.col("id") % 7 + 1).alias("n"))
    own = facts.facts_of(rows, "in", ["id", "n"])
    pairs = rules.activations(own, Rule("peers", (Condition("in", ("?a", "?n")), Condition("in", ("?b", "?n"))), ())).select("`?a`", "`?b`", "`?n`")
    by = rows.groupBy("n").count().where("n IS NOT NULL").agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    got = pairs.groupBy(F.spark_partition_id().alias("task"), (F.col("`?n`") == "0").alias("frequent")).count().collect()
    assert sum(r["count"] for r in got) == by == pairs.distinct().count()
    assert max(r["count"] for r in got if r.frequent) < 1200 * 1200  # no task has all pairs of a frequent value


def test_dealt_pairs_are_the_plain_join(spark, monkeypatch):
    from rulelake.model import Condition, Rule
    from rulelake.plans import deltas, rules

    kind = "id string, predicate string, args array<string>, timestamp long, source string"
    held = [(f"p{i}", "p", [f"x{i}", None if i == 9 else str(i % 3 * (i % 2)), "u" if i % 4 else "v"], 0, None) for i in range(12)] + [("q0", "q", ["0"], 0, "s"), ("p0", "p", ["x0", "0", "v"], 0, None)]
    own = spark.createDataFrame(held, kind)
    c = lambda *args: Condition("p", args)
    three = Rule("three", (c("?a", "?n", "?s"), c("?b", "?n", "?s"), Condition("q", ("?n",)), c("?c", "?n", "v")), ())
    two = Rule("two", (c("?a", "?n", "?s"), c("?b", "?n", "?s")), ())
    log = spark.createDataFrame([("p1", None, None, 0, None, -1, 0), ("p20", "p", ["x20", "0", "u"], 0, None, 1, 1), ("p21", "p", ["x21", "2", "u"], 0, None, 1, 2)], f"{kind}, d int, seq int")

    def told(bound):
        monkeypatch.setattr(rules, "PEERS", bound, raising=False)
        kept = deltas.Incremental(own.dropDuplicates(["id"]), two)
        frames = [rules.Session(own, [two, three], share=share).agenda() for share in (False, True)]
        frames += [rules.delta_activations(own.where("id < 'p4'"), own.where("id >= 'p4'"), two).select(*rules.AGENDA), kept.change(log).drop("bindings", "fact_sources"), kept.agenda()]
        out = [sorted(map(repr, (tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in f.collect()))) for f in frames]
        kept.drop()
        return out
    plain, dealt = told(1000), told(2)
    assert plain == dealt and all(plain) and plain[0] == plain[1]


def test_sets_of_long_rings_with_side_ways(spark, monkeypatch):
    import random

    from rulelake.operators import graph
    from rulelake.plans import tables

    rounds, become = [], tables.Held.become
    monkeypatch.setattr(tables.Held, "become", lambda self, df: rounds.append(1) or become(self, df))
    r, n = random.Random(3), 120
    made = {(i, (2 * i + 1) % n) for i in range(n)} | {(i, i // 2) for i in range(n) if r.random() < 0.45}
    made |= {(1000 + i, 1000 + (i + k) % 30) for i in range(30) for k in (1, 2, 5)} | {(1000, 3), (7, 2000), (2000, 2000)}
    names = {x: f"n{x * 7919 % 10007}" for s in made for x in s}
    to = {}
    for x, y in made:
        to.setdefault(x, set()).add(y)

    def reach(x):
        seen, go = set(), [x]
        while go:
            go += (new := to.get(go.pop(), set()) - seen)
            seen |= new
        return seen
    far = {x: reach(x) for x in names}
    want = {names[x]: "cycle:" + "+".join(sorted(names[y] for y in far[x] if x in far[y])) for x in names if x in far[x]}
    steps = spark.createDataFrame([(names[x], names[y]) for x, y in made], "x string, y string")
    monkeypatch.setattr(graph, "SET_STEPS", 60, raising=False)  # most is merged, and the second ring coloured
    assert {row.node: row.cycle for row in graph.cycles(steps).collect()} == want and len(rounds) < 30


def test_reach_over_sets_of_a_large_graph(spark, monkeypatch):
    from pathlib import Path

    from rulelake.operators import graph
    from rulelake.plans import tables

    made = {(f"t{i}", f"f{i % 7}") for i in range(600)} | {(f"f{i}", f"f{(i + 1) % 7}") for i in range(6)} | {("f5", "f0"), ("f4", "g"), ("g", "h"), ("h", "g"), ("h", "stop"), ("stop", "f6"), ("t3", "t2"), ("u", "v")}
    to = {x: {y for z, y in made if z == x and x != "stop"} for x, _ in made}
    far = {}
    for t in [f"t{i}" for i in range(600)] + ["alone"]:
        seen, go = {t}, [t]
        while go:
            go += (new := to.get(go.pop(), set()) - seen)
            seen |= new
        far[t] = seen
    steps, starts = spark.createDataFrame(sorted(made), "x string, y string"), spark.createDataFrame([(t,) for t in far], "start string")
    stop = spark.createDataFrame([("stop",)], "node string")
    monkeypatch.setattr(graph, "STATE_ROWS", 0, raising=False)  # as if the state were large
    assert {(r.start, r.node) for r in graph.closure(starts, steps, stop).collect()} == {(t, x) for t in far for x in far[t]}
    assert {r.start: r.n for r in graph.reach_sizes(starts, steps, stop).collect()} == {t: len(x) for t, x in far.items()}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {p.name for d in disk for p in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    table = tables.cut(steps.groupBy("y").count())
    assert shuffled() <= before and table.count() == len({y for _, y in made})  # nothing of it stays behind


def test_covered_functions_are_dealt_out(spark, monkeypatch):
    from rulelake.operators import coverage

    for name, value in (("NAMES", 4), ("TOLD_ROWS", 100)):
        monkeypatch.setattr(coverage, name, value, raising=False)
    data = [(f"t{i}", f"f{i % 2}", 10 + i % 3, 1) for i in range(60)]
    functions = [(f"f{i % 2}", None if i == 7 else f"n{i}", 10 + i // 2 % 2, 11) for i in range(50)]
    vetoed = [("t1", "f1", f"n{i}") for i in range(1, 20, 4)]
    want = {(t, f, n) for t, f, line, _ in data for g, n, s, e in functions if f == g and s <= line <= e} - set(vetoed)
    told = coverage.lcov_hits(spark.createDataFrame(data, "test string, file string, line long, count int"), spark.createDataFrame(functions, "file string, name string, start long, end long"),
                              spark.createDataFrame(vetoed, "test string, file string, name string"))
    assert sorted(map(repr, map(tuple, told.collect()))) == sorted(map(repr, want))
    assert "Generate inline(names" in told._jdf.queryExecution().optimizedPlan().toString()  # names leave their row after the join
    assert told.rdd.getNumPartitions() > len(want) // 100
