import json

import pytest
from pyspark.sql import functions as F

from rulelake.sources import files, stores
from rulelake.streaming import journal as stream


def test_damaged_lines_are_counted(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"p":"x","a":["1"],"src":"s","d":false}\nnot json\n\n{"p":"y","a":["2"],"src":null,"d":true}\n')
    rows, bad = files.jsonl(spark, str(tmp_path / "e.jsonl"), files.EDGE)
    assert [(r.p, r.a, r.d) for r in rows.collect()] == [("x", ["1"], False), ("y", ["2"], True)]
    assert tuple(bad.first()) == (1, 8)


def test_log_with_predecessor(spark, tmp_path):
    for name, ts in (("old", 1), ("new", 2)):
        (tmp_path / name).write_text(json.dumps({"ts": ts, "kind": "check", "event": "e", "consequences": [{"rule_id": "r", "action_type": "log"}]}) + "\n")
    rows = files.action_log(spark, str(tmp_path / "new"), str(tmp_path / "old")).orderBy("part").collect()
    assert [(r.ts, r.part) for r in rows] == [(1, 0), (2, 1)] and rows[0].consequences[0].rule_id == "r"


def test_lcov(spark):
    text = "TN:one\nSF:a.rs\nFNDA:0,save\nFNDA:3,load\nDA:1,1\nDA:2,0\nend_of_record\nTN:two\nSF:b.rs\nDA:9,4,sum\nend_of_record\n"
    got = [tuple(r)[2:] for r in files.lcov(spark.createDataFrame([("r", text)], "report string, text string")).orderBy("section", "tag", "line", "name").collect()]
    assert got == [("one", "a.rs", "DA", None, 1, 1), ("one", "a.rs", "DA", None, 2, 0), ("one", "a.rs", "FNDA", "load", None, 3), ("one", "a.rs", "FNDA", "save", None, 0), ("two", "b.rs", "DA", None, 9, 4)]


def test_jacoco(spark):
    xml = '<report name="r"><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="0" ci="2"/><line nr="4" mi="1" ci="0"/></sourcefile></package></report>'
    got = files.jacoco(spark.createDataFrame([("t", xml)], "test string, xml string")).orderBy("line").collect()
    assert [tuple(r) for r in got] == [("t", "p/q/A.java", 3, 2), ("t", "p/q/A.java", 4, 0)]


def test_notes(spark):
    note = "---\nname: x y\ntype: 'feedback'\nname: z\n---\nbody\n## one\ntext\n### sub\n## two\n- Never do it\n- a fact\n1. use that\n"
    n = spark.createDataFrame([("f", note), ("g", "no block")], "file string, text string")
    got = {r.file: (r.meta, r.body) for r in files.frontmatter(n).collect()}
    assert got["f"][0] == {"name": "z", "type": "feedback"} and got["f"][1].startswith("body\n") and got["g"] == ({}, "no block")
    body = files.frontmatter(n).select("file", F.col("body").alias("text")).where("file = 'f'")
    assert [(r.section, r.text.split("\n")[0]) for r in files.sections(body).orderBy("section").collect()] == [(0, "body"), (1, "## one"), (2, "## two")]
    assert [r.text for r in files.imperatives(n).orderBy("line").collect()] == ["Never do it", "use that"]


def test_collected_tests_and_symbols(spark):
    out = spark.createDataFrame([("a/test_x.py::test_one\n  a/test_x.py::C::test_two[1]\n\n2 tests collected",)], "text string")
    assert [r.test for r in files.collected_tests(out).collect()] == ["a/test_x.py::test_one", "a/test_x.py::C::test_two[1]"]
    code = spark.createDataFrame([("f", "use a::b;\npub async fn go() {}\ndef run(x):\nimport os\n")], "file string, text string")
    assert {(r.kind, r.name) for r in files.code_symbols(code).collect()} == {("function", "go"), ("function", "run"), ("import", "a::b"), ("import", "os")}


def test_edits_forward_and_back(spark):
    rows = [(1, "a b a", [("b", "c", False)], "a c a"), (2, "a b a", [("a", "x", False)], "?"), (3, "a b a", [("a", "x", True)], "x b x"), (4, "a", [("a", "b", False), ("b", "c", False)], "c"), (5, "a", [("", "b", False)], "?")]
    df = spark.createDataFrame(rows, "id int, text string, edits array<struct<old string, new string, all boolean>>, after_text string")
    got = {r.id: r.after for r in files.edited(df).collect()}
    assert got == {1: "a c a", 2: None, 3: "x b x", 4: "c", 5: None}
    back = {r.id: r.before for r in files.reversed_edits(df.where("id IN (1, 3, 4)").drop("text")).collect()}
    assert back == {1: "a b a", 3: "a b a", 4: "a"}


def test_hook_payloads(spark):
    p = [{"session_id": "s", "hook_event_name": "pre", "tool_name": "Edit", "tool_input": {"file_path": "a", "new_string": "n"}}, {"session_id": "s", "tool": "shell", "tool_input": {"command": "ls"}, "tool_response": {"exit_code": 2}}]
    rows = files.hook_events(spark.createDataFrame([(json.dumps(x),) for x in p] + [("{broken",)], "payload string")).collect()
    assert [(r.tool, r.file, r.command, r.new_text, r.exit) for r in rows] == [("Edit", "a", None, "n", None), ("Bash", None, "ls", None, 2), (None, None, None, None, None)]


def test_files_are_capped_by_size(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("é")
    (tmp_path / "s/b.txt").write_text("x" * 50)
    assert [r.text for r in files.files(spark, str(tmp_path), "*.txt", 10).collect()] == ["é"]


def test_store_versions_and_corruption(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    assert s.load() is None
    assert s.write(spark.range(3).toDF("x")) == 0 and s.write(spark.range(5).toDF("x")) == 1
    assert s.load().count() == 5
    spark.range(1).toDF("x").write.mode("append").parquet(str(tmp_path / "store/v1"))
    with pytest.raises(stores.Corrupt):
        s.load()
    log = spark.createDataFrame([(i, "x" * 20) for i in range(10)], "ts long, v string")
    kept = stores.rotated(log, 120).groupBy("generation").count().collect()
    assert {r.generation: r["count"] for r in kept} == {1: 2, 0: 3} or sum(r["count"] for r in kept) < 10


def test_streams(spark, tmp_path):
    src = tmp_path / "j"
    src.mkdir()
    rows = [{"ts": 1000 + i * 600, "sid": "s", "seq": i, "tags": ["a"] if i % 2 else ["a", "b"]} for i in range(12)]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.tag_counts(stream.read(spark, str(src)).repartition(2)).writeStream.format("memory").queryName("tags").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.tag: r.n for r in spark.sql("SELECT tag, sum(n) AS n FROM tags GROUP BY tag").collect()} == {"a": 12, "b": 6}


def test_streamed_prompt_classes_equal_the_batch(spark, tmp_path):
    from rulelake.operators import journey

    events = [("s", 1, "prompt", None, False), ("s", 2, "interrupt", None, False), ("s", 3, "prompt", None, False), ("s", 4, "prompt", None, True), ("s", 5, "prompt", None, False), ("s", 6, "prompt", "a", False),
              ("s", 7, "stop", None, False), ("s", 8, "prompt", None, True), ("t", 1, "tool", None, False), ("t", 2, "prompt", None, False)]
    schema = "sid string, seq long, event string, agent string, interrupted boolean"
    df = spark.createDataFrame(events, schema)
    want = sorted((r.sid, r.seq, r.mode) for r in journey.prompt_class(df).collect())
    assert [m for s, _, m in want if s == "s"] == ["fresh", "correction", "correction", "mid_turn", "fresh", "fresh"]
    src = str(tmp_path / "p")
    for part in (df.where("seq <= 3"), df.where("seq > 3")):
        part.coalesce(1).write.mode("append").json(src)
    got = []
    q = stream.sink(stream.prompt_classes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(src)), str(tmp_path / "c"), lambda b, n: got.extend(map(tuple, b.collect())), drain=True)
    assert q.awaitTermination(60), q.status
    assert sorted(got) == want


def test_ignore_lines_and_rotation_on_write(spark, tmp_path):
    from pyspark.sql import functions as F

    from rulelake.sources import files, stores

    for name in ("a.py", "target/x.py", "src/b.py", "src/gen/c.py", "src/gen/keep.py", "notes.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x")
    found = files.files(spark, str(tmp_path / "t"), "*.py", ignore=["target/", "src/gen/*", "!keep.py"])
    assert {r.path.rsplit("/t/", 1)[1] for r in found.collect()} == {"a.py", "src/b.py", "src/gen/keep.py"}
    log, rows = str(tmp_path / "log"), spark.range(100).select("id", F.lit("x" * 50).alias("t"))
    for n in range(3):
        stores.append_log(rows.withColumn("n", F.lit(n)), log, 4000)
    assert spark.read.json(log).agg(F.min("n"), F.max("n")).first()[:] == (2, 2) and spark.read.json(f"{log}.1").select("n").distinct().collect()[0].n == 1


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from rulelake.plans.tables import _running_in_ranges, running

    rows = [("a" if i % 3 else None, (i * 37) % 101, i % 5) for i in range(101)]
    for descending in (False, True):
        df = spark.createDataFrame(rows, "g string, o int, v int")
        once = {(r.g, r.o): (r.upto, r.total) for r in running(df, ["g"], "o", "v", descending).collect()}
        got = {(r.g, r.o): (r.upto, r.total) for r in _running_in_ranges(df, ["g"], "o", "v", F.desc("o") if descending else F.asc("o")).collect()}
        for g, o, _ in rows:
            own = [v for x, p, v in rows if x == g]
            assert got[g, o] == once[g, o] == (sum(v for x, p, v in rows if x == g and (p >= o if descending else p <= o)), sum(own))


def test_stored_layouts_are_skipped(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from rulelake.operators import facts, graph
    from rulelake.sources import layout

    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = spark.range(20_000).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("p"), F.col("id") % 4).alias("predicate"), F.array(F.concat(F.lit("a::b"), F.col("id") % 300), F.lit("x")).alias("args"))
        stored = layout.write(rows, f"{tmp_path}/facts")
        edges = layout.write(rows.select(F.expr("CAST(substr(id, 2) AS BIGINT)").alias("ord"), F.col("predicate").alias("p"), F.col("args").alias("a")), f"{tmp_path}/edges", "p", "a", None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.id for r in facts.by_id(stored, "f77").collect()} == {"f77"}
    want = {f"f{i}" for i in range(20_000) if i % 4 == 2 and i % 300 == 14}
    assert {r.id for r in facts.matching(stored, "p2", [(0, "a::b14")]).collect()} == want and want
    for name in ("b14", "a::b14", ":b14"):
        assert {f"f{r.ord}" for r in graph.query(edges, "p2", [name]).collect()} == want
    assert {f"f{r.ord}" for r in graph.query(edges, "p2", ["*b14", "x"]).collect()} == want and graph.query(edges, "p2", ["14"]).count() == 0
    plan = graph.matching(edges, "p2", ["b14"])._jdf.queryExecution().toString()
    assert "EqualTo(__first,41b)" in plan and "StringStartsWith(__first,41b:)" in plan and "EqualTo(p,p2)" in plan
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in glob.glob(f"{tmp_path}/edges/*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    stats = [{g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)} for g in groups]
    may = [s for s in stats if s["p"].min <= "p2" <= s["p"].max and s["__first"].min <= "41b:" and "41b" <= s["__first"].max]
    assert len(groups) >= 15 and len(may) <= 3


def test_hash_trees_against_the_full_join(spark, tmp_path, monkeypatch):
    import random

    from rulelake.operators import graph
    from rulelake.sources import hashtree

    r = random.Random(3)
    names = sorted({"/".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) + r.choice(["", ".rs"]) for _ in range(400)})
    before = {n: r.choice("xyz") for n in names}
    after = dict(before)
    for n in r.sample(names, 6):
        after.pop(n)
    for n in r.sample(sorted(after), 5):
        after[n] = "new"
    after |= {"a/new/one": "x", "z": "y"}
    read, children = [], hashtree.children

    def spied(tree, depth, folders):
        rows = children(tree, depth, folders)
        read.append({r.parent for r in rows.select("parent").distinct().collect()})
        return rows
    monkeypatch.setattr(hashtree, "children", spied)
    for case, (x, y) in enumerate([(before, after), (after, before), (before, before), ({}, after), (before, {})]):
        read.clear()
        a, b = (spark.createDataFrame(sorted(t.items()), "path string, hash string") for t in (x, y))
        got = sorted((c.path, c.state) for c in hashtree.changes(hashtree.write(a, f"{tmp_path}/{case}a"), hashtree.write(b, f"{tmp_path}/{case}b")).collect())
        assert got == sorted((c.path, c.state) for c in graph.freshness(a, b).collect())
        if case == 2:
            assert not read
    for few in (0, 500):
        monkeypatch.setattr(hashtree, "LISTED", few)
        read.clear()
        one = {**before, names[7]: "changed"}
        trees = [hashtree.write(spark.createDataFrame(sorted(t.items()), "path string, hash string"), f"{tmp_path}/{few}{k}") for k, t in enumerate((before, one))]
        assert [tuple(c) for c in hashtree.changes(*trees).collect()] == [(names[7], "changed")]
        folders = names[7].split("/")
        assert len(read) <= 2 * (len(folders) + 1)
        for parents in read:  # nothing beside the folders that lead to the changed file
            assert parents <= {"/".join(folders[:i]) for i in range(len(folders) + 1)}
