"""Content audits: rules over files and lines, with gates, exemptions, rollups and joined fact rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import needles


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """file, line_no (from 1), line, and the file's line count."""
    parts = F.split(F.col(text), "\n")
    return files.select("file", F.size(parts).alias("n_lines"), F.posexplode(parts).alias("pos", "line")).select(
        "file", (F.col("pos") + 1).alias("line_no"), "line", "n_lines")


def line_count(text: Column) -> Column:
    """Lines as split at each line end."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))


def gated(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, rule) pairs that pass the rule's gates: path part, extension, more lines than a bound. Rules are few."""
    from ..plans.tables import small

    ok = (F.col("path_part").isNull() | F.contains("file", "path_part")) & (F.col("ext").isNull() | (_extension(F.col("file")) == F.col("ext"))) & (
        F.col("min_lines").isNull() | (F.col("n_lines") > F.col("min_lines")))
    return files.join(small(rules), ok)


def _passes(rule) -> Column:
    """A rule's gates over a file."""
    ok = F.lit(True)
    if rule.path_part is not None:
        ok = ok & F.contains("file", F.lit(rule.path_part))
    if rule.ext is not None:
        ok = ok & (_extension(F.col("file")) == rule.ext)
    if rule.min_lines is not None:
        ok = ok & (F.col("n_lines") > rule.min_lines)
    return ok


class ContentRule(NamedTuple):
    """A rule over texts: its needle (without one it hits every file that passes) and its gates."""

    rule_id: str
    level: str
    needle: str | None = None
    path_part: str | None = None
    ext: str | None = None
    min_lines: int | None = None


#: Rules as rows of a table, or as they were read from a document.
Rules = DataFrame | Sequence[ContentRule]


def _few(rules: Rules) -> Sequence | None:
    """The rules, if each of them can be an expression of its own; reads no more than that many rows."""
    some = rules.limit(needles.FEW + 1).collect() if isinstance(rules, DataFrame) else rules
    return some if len(some) <= needles.FEW else None


def _rows(files: DataFrame, rules: Rules) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else files.sparkSession.createDataFrame(list(rules), "rule_id string, level string, needle string, path_part string, ext string, min_lines int")


def _many(files: DataFrame, rules: DataFrame, by_line: bool) -> DataFrame:
    """(file, rule_id, level, line_no, n) of rules with needles, all found in one pass over the texts: by one automaton, or
    where there are too many for one, by windows that are joined with them."""
    asked = rules.select("needle").where("needle <> '' AND NOT contains(needle, '\n')").distinct()
    told = [r.needle for r in asked.limit(needles.MOST + 1).collect()]
    if len(told) > needles.MOST:
        hits_ = needles.windows(files, asked, by_line)
        return gated(hits_.withColumnRenamed("needle", "of"), rules).where("of = needle").select("file", "rule_id", "level", "line_no", "n")
    told.sort()
    numbered = files.sparkSession.createDataFrame(list(enumerate(told)), "needle_no int, needle string") if told else rules.select(F.lit(0).alias("needle_no"), "needle").limit(0)
    known = rules.withColumnRenamed("needle", "of").join(numbered, F.col("of") == F.col("needle")).drop("of", "needle")
    hits_ = needles.found(files, told, by_line)
    return gated(hits_.withColumnRenamed("needle", "no"), known).where("no = needle_no").select("file", "rule_id", "level", "line_no", "n")


def hits(files: DataFrame, rules: Rules) -> DataFrame:
    """One row for each non-overlapping occurrence of a rule's needle in a line; a rule without a needle hits line 1."""
    few, rules = _few(rules), _rows(files, rules)
    if few is None and needles.available():
        per_line = _many(files, rules, True)
    else:
        cut = files.select("file", line_count(F.col("text")).alias("n_lines"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        told = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), F.when(_passes(r), needles.times(F.col("line"), r.needle)).alias("n"))
                for r in (few if few is not None else rules.collect()) if needles.usable(r.needle)]
        per_line = cut.select("file", (F.col("pos") + 1).alias("line_no"), F.inline(F.filter(_structs(told), lambda x: x["n"] > 0)))
    each = per_line.select("file", "rule_id", "level", "line_no", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    if few is not None and all(r.needle is not None for r in few):
        return each
    whole = gated(files.select("file", line_count(F.col("text")).alias("n_lines")), rules.where("needle IS NULL")).select(
        "file", "rule_id", "level", F.lit(1).alias("line_no"), F.lit(1).cast("long").alias("k"))
    return each.unionByName(whole)


def _structs(told: list[Column]) -> Column:
    return F.array(*told) if told else F.array().cast("array<struct<rule_id:string,level:string,n:bigint>>")


def hit_counts(files: DataFrame, rules: Rules) -> DataFrame:
    """Hits by rule and file without making a row for each occurrence: no occurrence crosses a line end (a needle with
    one hits nothing), so a file's count is that of its whole text."""
    few = _few(rules)
    if few is None and needles.available():
        rules = _rows(files, rules)
        some = _many(files, rules, False).select("rule_id", "level", "file", F.col("n").alias("hits"))
        return some.unionByName(gated(files.select("file", line_count(F.col("text")).alias("n_lines")), rules.where("needle IS NULL")).select(
            "rule_id", "level", "file", F.lit(1).cast("long").alias("hits")))
    one = F.lit(1).cast("long")
    told = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), F.when(_passes(r), one if r.needle is None else needles.times(F.col("text"), r.needle)).alias("n"))
            for r in (few if few is not None else _rows(files, rules).collect()) if r.needle is None or needles.usable(r.needle)]
    rows = files.withColumn("n_lines", line_count(F.col("text"))).select("file", F.inline(F.filter(_structs(told), lambda x: x["n"] > 0)))
    return rows.select("rule_id", "level", "file", F.col("n").alias("hits"))


def previous_line(all_lines: DataFrame) -> DataFrame:
    """Each line with the last one before it that is neither blank nor an attribute (#[...])."""
    telling = F.when((F.trim("line") != "") & ~F.trim("line").startswith("#["), F.trim("line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return all_lines.withColumn("previous", F.last(telling, True).over(w))


def not_documented(found: DataFrame, all_lines: DataFrame) -> DataFrame:
    """Hits whose line does not follow a doc comment."""
    documented = previous_line(all_lines).where(F.col("previous").startswith("///")).select("file", "line_no")
    return found.join(documented, ["file", "line_no"], "left_anti")


def not_exempt(found: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Hits of (file, rule) pairs without an exemption."""
    return found.join(exemptions.select("file", "rule_id"), ["file", "rule_id"], "left_anti")


def rollup(counts: DataFrame, offenders: int = 3) -> DataFrame:
    """Per rule: hits, files and the files with most hits; blocking rules first, then by hits."""
    per_file = counts.groupBy("rule_id", "level", "file").agg(F.sum("hits").alias("hits"))
    first = per_file.withColumn("rn", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("hits"), "file"))).where(F.col("rn") <= offenders)  # cut in each task first
    named = first.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file"))), lambda s: s["file"]).alias("offenders"))
    total = per_file.groupBy("rule_id", "level").agg(F.sum("hits").alias("hits"), F.count("*").alias("files"))
    return total.join(named, "rule_id").orderBy(F.when(F.col("level") == "block", 0).otherwise(1), F.desc("hits"), "rule_id")


def union_rule(facts: DataFrame, conditions: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Facts (file, predicate, args) that match any of a rule's conditions, in files where every condition has a match."""
    from ..model import is_variable
    from ..plans.tables import cut

    holds = []
    for predicate, args in conditions:
        hit = (F.col("predicate") == predicate) & (F.size("args") == len(args))
        for i, a in enumerate(args):
            hit = hit if is_variable(a) else hit & (F.get("args", F.lit(i)) == a)
        holds.append(hit)
    met = F.filter(F.array(*[F.when(hit, n) for n, hit in enumerate(holds)]), lambda n: n.isNotNull())
    out = cut(facts.select("*", F.explode(met).alias("condition")))  # facts may come from parsers: they run once
    full = out.groupBy("file").agg(F.count_distinct("condition").alias("n")).where(F.col("n") == len(conditions)).select("file")
    return out.join(full, "file", "left_semi")


def missing(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file, pattern) for patterns that a file's text lacks."""
    return needles.present(files, patterns, absent=True)


def without_tests(files: DataFrame) -> DataFrame:
    """files with their test blocks blanked (a #[cfg(test)] or #[test] item with its braces), so that line numbers stay."""
    import re

    from ..sources.syntax import closing, masked

    head = re.compile(r"#\[(?:cfg\(test\)|(?:\w+::)?test\b)[^\]]*\]")

    def stripped(text):
        if text is None or "test" not in text:
            return text
        code, out, at = masked(text), [], 0
        for m in head.finditer(code):
            brace = code.find("{", m.end())
            if m.start() >= at and brace >= 0:
                end = closing(code, brace)
                out += [text[at:m.start()], re.sub(r"[^\n]", " ", text[m.start():end])]
                at = end
        return "".join([*out, text[at:]])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[stripped(t) for t in pdf["text"]])
    return files.mapInPandas(run, files.schema)


def pack_rule(facts: DataFrame, files: DataFrame, rule_id: str, conditions: Sequence[tuple[str, Sequence[str]]], path_part: str | None = None, ext: str | None = None, content: str | None = None) -> DataFrame:
    """Facts of language packs (file, line, predicate, args) joined on their shared variables inside one file, in files that
    pass the gates: (rule_id, file, line) of the first condition's fact, each once."""
    from functools import reduce

    from ..plans.rules import alpha, beta

    own = facts.select(F.concat_ws(":", "file", "line").alias("id"), "predicate", F.concat(F.array("file"), F.col("args")).alias("args"), F.col("line").cast("string").alias("source"))
    rows = reduce(beta, [alpha(own, p, ["?__file", *args], n) for n, (p, args) in enumerate(conditions)])
    asked = files.where(F.contains("file", F.lit(path_part))) if path_part else files
    asked = asked.where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)) == ext) if ext else asked
    asked = asked.where(F.contains("text", F.lit(content))) if content else asked
    return rows.select(F.lit(rule_id).alias("rule_id"), F.col("`?__file`").alias("file"), F.col("__src0").cast("int").alias("line")).distinct().join(asked.select("file").distinct(), "file", "left_semi")


def containing(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file, pattern) for patterns that a file's text has."""
    return needles.present(files, patterns)


def path_facts(files: DataFrame) -> DataFrame:
    """Segments, lower-case extension, the path itself and each of its ancestors, as (predicate, args)."""
    parts = F.filter(F.split("file", "/"), lambda p: p != "")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(
        F.array().cast("array<string>"))
    extension = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    one = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("predicate"), v.alias("value")))
    told = F.concat(one("file_path_matches", F.array_distinct(parts)), one("file_extension_is", F.filter(F.array(extension), lambda e: e != "")),
                    one("project_path_is", F.array(F.array_join(parts, "/"))), one("project_path_under", ups))
    return files.select("file", F.inline(told)).distinct()


def increased(now: DataFrame, before: DataFrame, key: Sequence[str], n: str) -> DataFrame:
    """Counts that are new or larger than before."""
    return now.join(before.select(*key, F.col(n).alias("__was")), list(key), "left").where(F.col(n) > F.coalesce("__was", F.lit(0))).drop("__was")
