"""Test coverage: hits of tests on regions, changed lines, gaps, and which tests a change needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of one block of the range join, levels of doubled blocks, and blocks of a span that is stored block by block.
BLOCK, LEVELS, FEW_BLOCKS = 256, 56, 4
#: Rows of one partition where sets are compared.
PART_ROWS = 250_000
#: Names of functions that one row holds where they are told together, parts into which the tests of such functions are
#: dealt, and rows that one task tells.
NAMES, SHARES, TOLD_ROWS = 500, 8, 50_000_000


def validated(hits: DataFrame) -> DataFrame:
    """Hit records with lower-case revision, each once; an error if one is no record of the known version (v 1, kind hit, a
    test, a region, lines in order) or if they are of several tools or revisions."""
    rows = hits.withColumn("revision", F.lower("revision")).dropDuplicates()
    good = F.lit(True)
    for column, holds in (("v", "v = 1"), ("kind", "kind = 'hit'"), ("test", "trim(test) <> ''"), ("region", "trim(region) <> ''")):
        if column in hits.columns:
            good = good & F.coalesce(F.expr(holds), F.lit(False))
    if "start_line" in hits.columns:
        good = good & F.coalesce(F.expr("start_line <= end_line"), F.lit(True))
    kinds = rows.agg(F.count_distinct("tool").alias("tools"), F.count_distinct("revision").alias("revisions"), F.count_if(~good).alias("bad"))
    checked = kinds.select(F.assert_true(F.col("tools") <= 1, F.lit("hits of several tools")).alias("a"), F.assert_true(F.col("revisions") <= 1, F.lit("hits of several revisions")).alias("b"),
                           F.assert_true(F.col("bad") == 0, F.lit("rows that are no hit records")).alias("c"))
    return rows.join(F.broadcast(checked.where("a IS NULL AND b IS NULL AND c IS NULL").select(F.lit(1).alias("__ok"))), F.lit(True), "left_semi")


def nodes(start: Column, end: Column) -> Column:
    """Array of (level, node): aligned stretches of 2**level blocks that together cover the blocks of a span, two for each
    level at most. A span of a few blocks is these blocks."""
    first, last = F.floor(start / BLOCK).cast("long"), F.floor(end / BLOCK).cast("long")
    node = lambda level, at: F.struct(level.cast("int").alias("level"), at.cast("long").alias("node"))
    one = F.lit(1).cast("long")

    def climb(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        taken = F.concat(state["out"], F.when(left, F.array(node(level, a))).otherwise(none), F.when(right & ~(left & (a == b)), F.array(node(level, b))).otherwise(none))
        up = F.floor((a + F.when(left, one).otherwise(0)) / 2).cast("long"), F.floor((b - F.when(right, one).otherwise(0)) / 2).cast("long")
        return F.struct(F.when(a > b, a).otherwise(up[0]).alias("a"), F.when(a > b, b).otherwise(up[1]).alias("b"), taken.alias("out"))  # past each other they stay so

    none = F.array().cast("array<struct<level:int,node:bigint>>")
    zero = F.struct(first.alias("a"), last.alias("b"), none.alias("out"))
    wide = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero, climb, lambda state: state["out"])
    few = F.transform(F.sequence(first, last), lambda i: node(F.lit(0), i))
    return F.when(start > end, none).when(last - first < FEW_BLOCKS, few).otherwise(wide)


def lines_in_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line) with every span (file, start, end) that holds the line. A span is stored at the aligned stretches of
    blocks that make it up, and a line looks into the stretch that holds it on each level that some span uses: an
    equi-join whose rows grow with the logarithm of a span's length."""
    placed = spans.withColumn("__n", F.explode(nodes(F.col("start"), F.col("end")))).withColumns({"__level": F.col("__n.level"), "__node": F.col("__n.node")}).drop("__n")
    levels = placed.agg(F.collect_set("__level").alias("__levels"))  # one row of LEVELS numbers at most
    looking = lines.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn(
        "__node", F.call_function("shiftright", F.floor(F.col("line") / BLOCK).cast("long"), F.col("__level")))
    return looking.join(placed, ["file", "__level", "__node"]).where("line BETWEEN start AND `end`").drop("__level", "__node")


def lcov_hits(data: DataFrame, functions: DataFrame, vetoed: DataFrame) -> DataFrame:
    """(test, file, name): functions (file, name, start, end) with a covered line (test, file, line, count), unless the
    record says that the function was not entered (vetoed: test, file, name)."""
    from ..plans.tables import cut

    # lines and spans repeat over tests and functions: each is placed once, and functions of the same spans are told together,
    # so that a (test, function) pair appears once and only as a result
    lines = data.where("count > 0").select("test", "file", "line").distinct()
    spans = functions.select("file", "start", "end").distinct()
    placed = lines_in_spans(lines.select("file", "line").distinct(), spans)
    alike = functions.groupBy("file", "name").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    told = alike.select("file", "spans").distinct().select("file", "spans", F.inline("spans"))
    entered = placed.join(told, ["file", "start", "end"]).select("file", "line", "spans").distinct()
    hit = cut(lines.join(entered, ["file", "line"]).select("test", "file", "spans").distinct())
    # the result has a row for each test and function: functions alike are held by many a row and taken out of it last, by
    # tasks whose number grows with the result
    sizes = alike.groupBy("file", "spans").agg(F.count("*").alias("n"))
    rows = hit.groupBy("file", "spans").count().join(sizes, ["file", "spans"]).agg(F.sum(F.col("count").cast("double") * F.col("n"))).first()[0] or 0
    parts = max(int(hit.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(rows // TOLD_ROWS, 10_000)))
    held = alike.join(sizes, ["file", "spans"]).withColumn("__block", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / NAMES))).groupBy("file", "spans", "__block").agg(F.collect_list(F.struct("name")).alias("names"))
    held = held.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(parts, "file", "spans", "__share")
    doubted = hit.join(vetoed.select("test", F.lit(True).alias("doubted")).distinct(), "test", "left")
    dealt = doubted.where("doubted IS NULL").withColumn("__share", F.pmod(F.hash("test"), F.lit(SHARES))).repartition(parts, "file", "spans", "__share")
    sure = dealt.join(held, ["file", "spans", "__share"]).select("test", "file", F.inline("names"))
    rest = doubted.where("doubted").join(alike, ["file", "spans"]).select("test", "file", "name")
    return sure.unionByName(rest.join(vetoed.select("test", "file", "name"), ["test", "file", "name"], "left_anti"))


def changed_regions(changed: DataFrame, sites: DataFrame) -> DataFrame:
    """(change, region): sites (file, region, start, end) that hold a changed line (change, file, line)."""
    return lines_in_spans(changed, sites).select("change", "region").distinct()


def gaps(changed: DataFrame, hits: DataFrame, usable: bool = True) -> DataFrame:
    """Changed regions that no test hits; a stale or corrupt store hits nothing."""
    regions = changed.select("region").distinct()
    return regions.join(hits.select("region"), "region", "left_anti") if usable else regions


def select_dynamic(changed: DataFrame, hits: DataFrame) -> DataFrame:
    """(test, region): hits on a changed region, or on the whole file of one (region file:<path>)."""
    asked = changed.select("region", "file").distinct()
    direct = hits.join(asked.select("region"), "region", "left_semi").select("test", "region")
    whole = hits.join(asked.select(F.concat(F.lit("file:"), "file").alias("region"), F.col("region").alias("changed")), "region").select("test", F.col("changed").alias("region"))
    return direct.unionByName(whole).distinct()


def select_static(functions: DataFrame, reaches: DataFrame, bin_reaches: DataFrame, definitions: DataFrame) -> DataFrame:
    """(test, region): tests that reach a changed function (file, leaf, region), directly or through a program."""
    from ..functions.text import leaf

    target = definitions.withColumn("leaf", leaf(F.col("fn"))).join(functions, ["file", "leaf"]).select("fn", "region").distinct()
    through = reaches.select("test", F.col("fn").alias("main")).join(bin_reaches, "main").select("test", "fn")
    return reaches.select("test", "fn").unionByName(through).distinct().join(target, "fn").select("test", "region").distinct()


def select_tests(dynamic: DataFrame, static: DataFrame) -> DataFrame:
    """(test, evidence) with the sorted regions that ask for it."""
    both = dynamic.withColumn("evidence", F.lit("dynamic")).unionByName(static.withColumn("evidence", F.lit("static")))
    return both.groupBy("test", "evidence").agg(F.array_sort(F.collect_set("region")).alias("regions"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of two trees (path, text) whose text differs or that one lacks."""
    both = old.select("path", F.col("text").alias("old")).join(new.select("path", F.col("text").alias("new")), "path", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def changed_lines(before: str, after: str, most_cells: int = 4_000_000) -> list[int]:
    """Lines of after (from 1) outside a longest common subsequence with before, common ends trimmed first. Beyond the
    cell budget every untrimmed line counts as changed."""
    a, b = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if len(a) * len(b) > most_cells:
        return list(range(head + 1, head + len(b) + 1))
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i] == b[j] else max(longest[i + 1][j], longest[i][j + 1])
    i = j = 0
    out = []
    while j < len(b):
        if i < len(a) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < len(a) and longest[i + 1][j] >= longest[i][j + 1]:
            i += 1
        else:
            out.append(head + j + 1)
            j += 1
    return out


def diff_lines(files: DataFrame) -> DataFrame:
    """(path, line) of files (path, old, new) that changed; files are compared one by one in Arrow batches."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, n) for p, o, w in zip(pdf["path"], pdf["old"], pdf["new"]) for n in changed_lines(o or "", w or "")]
            yield pd.DataFrame(rows, columns=["path", "line"])
    return files.select("path", "old", "new").mapInPandas(run, "path string, line long")


def set_changes(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """Items added to and removed from each key, in one shuffle whose partitions have a bounded number of rows."""
    marked = new.select(key, item, F.lit(True).alias("__now")).unionByName(old.select(key, item, F.lit(False).alias("__now")))
    parts = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // PART_ROWS))
    sides = marked.repartition(parts, key, item).groupBy(key, item).agg(F.bool_or("__now").alias("__new"), F.bool_or(~F.col("__now")).alias("__old"))
    return sides.where("__new <> __old").select(key, item, F.when(F.col("__new"), "added").otherwise("removed").alias("change"))
