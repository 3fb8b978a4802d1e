"""Readers: line records with counted damage, coverage formats, notes, commands and hook payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE = "p string, a array<string>, src string, d boolean"
JOURNAL = ("v int, ts bigint, sid string, seq bigint, tool string, path string, ext string, module string, tags array<string>, subject string, "
           "command_exit int, kind string, mode string, host string, turn string, agent string, agent_type string, kalpa string")
LOG = ("ts bigint, kind string, event string, phase string, tool string, file string, exit int, subject string, sid string, kalpa string, mode string, "
       "duration_secs bigint, matched_start boolean, sha string, confidence_band string, consequences array<struct<rule_id string, action_type string>>")
HIT = "v int, kind string, test string, region string, file string, start_line bigint, end_line bigint, hit_kind string, revision string, tool string"
PAYLOAD = ("session_id string, cwd string, hook_event_name string, tool_name string, tool string, "
           "tool_input struct<file_path string, path string, command string, content string, new_string string, old_string string, "
           "edits array<struct<old_string string, new_string string>>>, tool_response struct<exit_code int, stdout string>")
DAMAGED = "_damaged"


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of a line file, and one row with how many lines and bytes were no record."""
    return records(spark.read.text(path), schema)


def records(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """The same for a table of lines (value)."""
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {DAMAGED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}).alias("r"))
    broken = F.col("r").isNull() | F.col(f"r.{DAMAGED}").isNotNull()
    bad = parsed.agg(F.count_if(broken).alias("lines"), F.coalesce(F.sum(F.when(broken, F.octet_length("value"))), F.lit(0)).alias("bytes"))
    return parsed.where(~broken).select("r.*").drop(DAMAGED), bad


def action_log(spark: SparkSession, path: str, rotated: str | None = None) -> DataFrame:
    """The log with its rotated predecessor before it."""
    now = jsonl(spark, path, LOG)[0].withColumn("part", F.lit(1))
    return now if rotated is None else jsonl(spark, rotated, LOG)[0].withColumn("part", F.lit(0)).unionByName(now)


def files(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int = 1 << 20, ignore: list[str] | None = None) -> DataFrame:
    """path and text of the files below a folder; larger and ignored ones are left out before their content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    kept = found.where(F.col("length") <= most_bytes)
    if ignore:
        inside = F.regexp_replace("path", r"^(?:[a-z]+:/*)?" + re.escape("/" + root.split(":", 1)[-1].strip("/")) + "/", "") if root else F.col("path")
        kept = kept.where(~ignored(inside, ignore))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is left out by the lines of an ignore file: the last line that matches it or one of its
    folders decides, ! takes back, a slash inside or before ties a pattern to the root, one after it to folders."""
    out = F.lit(False)
    for line in patterns:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, rooted = p.endswith("/"), "/" in p.rstrip("/")
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", p.strip("/")))
        hit = path.rlike(("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def lcov(reports: DataFrame) -> DataFrame:
    """reports (report, text) as records (report, section, test, file, tag, name, line, count)."""
    return lcov_lines(reports.select("report", F.posexplode(F.split("text", r"\r?\n")).alias("n", "l")))


def lcov_lines(lines: DataFrame) -> DataFrame:
    """lines (report, n, l) of reports, in order of n, as records (report, section, test, file, tag, name, line, count). A
    section ends at end_of_record; its test and file hold for all its lines. Reports are sorted once, and never one value."""
    known_tag = F.regexp_extract("l", "^(TN|SF|DA|FNDA):", 1)
    rows = lines.withColumns({"tag": known_tag, "value": F.regexp_extract("l", "^[A-Z]+:(.*)$", 1), "end": F.col("l") == "end_of_record"}).where("tag <> '' OR `end`").drop("l")
    order = Window.partitionBy("report").orderBy("n")
    section = F.coalesce(F.sum(F.col("end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("tag") == t, F.struct("section", "value")), True).over(inside) for k, t in (("test", "TN"), ("file", "SF"))}
    known = rows.withColumn("section", section).withColumns(last).withColumns({k: F.when(F.col(k)["section"] == F.col("section"), F.col(k)["value"]) for k in last})
    part = lambda i: F.try_element_at(F.split("value", ",", 2), F.lit(i))
    data = known.where(F.col("tag").isin("DA", "FNDA"))
    entered = F.col("tag") == "FNDA"
    return data.select("report", "section", "test", "file", "tag", F.when(entered, part(2)).alias("name"), F.when(~entered, part(1).try_cast("long")).alias("line"),
                       F.when(entered, part(1)).otherwise(F.regexp_extract(part(2), r"^(\d+)", 1)).try_cast("long").alias("count"))


def jacoco(reports: DataFrame) -> DataFrame:
    """reports (test, xml) as (test, file, line, covered instructions)."""
    schema = "package array<struct<_name string, sourcefile array<struct<_name string, line array<struct<_nr bigint, _ci bigint>>>>>>"
    parsed = reports.select("test", F.from_xml("xml", schema).alias("r"))
    packages = parsed.select("test", F.explode("r.package").alias("p"))
    sources = packages.select("test", F.col("p._name").alias("dir"), F.explode("p.sourcefile").alias("s"))
    return sources.select("test", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "s._name").alias("file"), F.explode("s.line").alias("l")).select(
        "test", "file", F.col("l._nr").alias("line"), F.col("l._ci").alias("count"))


def collected_tests(outputs: DataFrame) -> DataFrame:
    """Test ids (path::name) of a collect-only run's output."""
    return outputs.select(F.explode(F.split("text", r"\r?\n")).alias("l")).select(F.trim("l").alias("test")).where(F.col("test").rlike(r"^[^\s:]+\.py::\S+"))


PROPERTY = "id string, status string, kind string, tier string, encodings array<string>, depends_on array<string>"
RESULT = "v int, property string, verifier string, status string, revision string, tier string, artifact_sha256 string, ts bigint"


def listed(documents: DataFrame, name: str, schema: str) -> DataFrame:
    """The records of a JSON document's list of that name, over all documents (text); other documents give none."""
    told = F.from_json("text", f"{name} array<struct<{', '.join(f'{a}: {b}' for a, b in (x.strip().split(' ', 1) for x in _fields(schema)))}>>")
    return documents.select(F.explode(told[name]).alias("r")).select("r.*")


def _fields(schema: str) -> list[str]:
    return schema.split(", ")


def properties(documents: DataFrame) -> DataFrame:
    return listed(documents, "properties", PROPERTY)


def results(documents: DataFrame) -> DataFrame:
    return listed(documents, "results", RESULT)


def allowed(documents: DataFrame) -> DataFrame:
    """Approved artifacts, in lower case."""
    return listed(documents, "artifacts", "artifact_sha256 string, approved_by string").withColumn("artifact_sha256", F.lower("artifact_sha256"))


def frontmatter(notes: DataFrame) -> DataFrame:
    """notes (file, text) with the leading --- block as a map and the body after it."""
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda l: l.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda l: F.struct(F.trim(F.regexp_extract(l, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(l, "^[^:]*:(.*)$", 1), "^\\s*[\"']|[\"']\\s*$", "")).alias("v")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    body = F.regexp_replace("text", r"(?s)\A---\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)", "")
    return notes.withColumns({"meta": last, "body": body})


#: How a list item that is an instruction begins, in lower case.
IMPERATIVE = ("don't", "do not", "never", "always", "avoid", "prefer", "use ", "make sure", "stop ", "reserve", "drop ", "no ")


def imperatives(notes: DataFrame) -> DataFrame:
    """List items that tell the reader what to do: file, line, text. An item is what follows "- ", "* " or a number; only
    numbered ones may have more blanks before their first word."""
    from ..functions.text import ascii_lower

    lines = notes.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "l")).withColumn("l", F.regexp_replace("l", r"^\s+", ""))
    marked = F.col("l").startswith("- ") | F.col("l").startswith("* ")
    body = F.when(marked, F.substring("l", 3, 1 << 30)).when(F.col("l").rlike("^[0-9]"), F.trim(F.regexp_replace("l", r"^[0-9]+[.)]*", "")))
    begins = ascii_lower(F.col("body")).rlike("^(?:" + "|".join(IMPERATIVE) + ")")
    return lines.withColumn("body", body).where(begins).select("file", (F.col("n") + 1).alias("line"), F.trim("body").alias("text"))


def sections(notes: DataFrame) -> DataFrame:
    """notes (file, text) cut before each ## heading: file, section (0 is what stands before the first), text."""
    lines = notes.select("file", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    number = F.sum(F.col("l").rlike(r"^##\s").cast("int")).over(Window.partitionBy("file").orderBy("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "l")))
    return lines.withColumn("section", number).groupBy("file", "section").agg(F.array_join(F.transform(ordered, lambda s: s["l"]), "\n").alias("text")).where(F.trim("text") != "")


def edited(rows: DataFrame, text: str = "text", edits: str = "edits") -> DataFrame:
    """Text after its edits (old, new, all) in order; null from the first that does not hold: old must occur, and
    exactly once unless all are replaced."""
    from ..functions.text import occurrences

    def step(acc: Column, e: Column) -> Column:
        n = occurrences(acc, e["old"])
        return F.when((n == 1) | ((n > 1) & e["all"]), F.replace(acc, e["old"], e["new"]))
    return rows.withColumn("after", F.aggregate(edits, F.col(text), step))


def reversed_edits(rows: DataFrame) -> DataFrame:
    """The text before, from the text after: edits undone in reverse order, accepted only if doing them again gives the
    text after; else null."""
    back = rows.withColumn("__undo", F.transform(F.reverse("edits"), lambda e: F.struct(e["new"].alias("old"), e["old"].alias("new"), e["all"].alias("all"))))
    undone = edited(back, "after_text", "__undo").withColumnRenamed("after", "__was")
    again = edited(undone.withColumn("text", F.col("__was")))
    return again.withColumn("before", F.when(F.col("after") == F.col("after_text"), F.col("__was"))).drop("__undo", "__was", "after", "text")


#: The hosts' names of the same tools, and one host's names of the same events.
TOOLS = {"apply_patch": "Edit", "replace": "Edit", "edit_file": "Edit", "write_file": "Write", "shell": "Bash", "run_shell_command": "Bash", "exec_command": "Bash", "read_file": "Read"}
EVENTS = {"BeforeAgent": "UserPromptSubmit", "AfterAgent": "Stop", "BeforeTool": "PreToolUse", "AfterTool": "PostToolUse"}


def hook_events(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Hook payloads (JSON text) of any host as one shape; what cannot be read is null. Several edits of one file are
    one text, joined by line ends."""
    named = lambda known, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c), c)
    many = lambda field: F.when(F.size("p.tool_input.edits") > 0, F.array_join(F.col(f"p.tool_input.edits.{field}"), "\n"))
    p = F.from_json(column, PAYLOAD)
    return payloads.withColumn("p", p).withColumns({
        "session_id": F.col("p.session_id"), "event": named(EVENTS, F.col("p.hook_event_name")), "tool": named(TOOLS, F.coalesce("p.tool_name", "p.tool")),
        "second_host": F.coalesce(F.col("p.hook_event_name").isin(*EVENTS), F.lit(False)),
        "file": F.coalesce("p.tool_input.file_path", "p.tool_input.path"), "command": F.col("p.tool_input.command"),
        "new_text": F.coalesce(many("new_string"), "p.tool_input.new_string", "p.tool_input.content"),
        "old_text": F.coalesce(many("old_string"), "p.tool_input.old_string"), "exit": F.col("p.tool_response.exit_code")}).drop("p")


def code_symbols(files_: DataFrame) -> DataFrame:
    """Functions and imports named in source text (file, text), by pattern: file, kind, name."""
    functions = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:fn|def|func|function)\s+([A-Za-z_]\w*)"), F.lit(1))
    imports = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:use|import|from)\s+([A-Za-z_][\w:.]*)"), F.lit(1))
    one = lambda kind, xs: F.transform(F.array_distinct(xs), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    return files_.select("file", F.inline(F.concat(one("function", functions), one("import", imports))))
