"""Outcomes of builds, tests, proofs and bug checks from command output; what holds last counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Toolchain:
    """How a command family is recognised and its output read: regular expressions, later definitions replace earlier."""

    id: str
    command: str
    success: str | None = None
    failure: str | None = None
    passed: tuple[str, ...] = ()
    failed: tuple[str, ...] = ()
    kind: str = "test"
    modes: tuple[str, str] = ("sum", "sum")  # how passed and failed are read: the sum of all matches, or the first
    section: str | None = None  # only what follows the first match of this is read for counts


#: Built-in definitions: patterns of public tools' summaries.
BUILTIN = (
    Toolchain("cargo-test", r"^cargo (test|nextest)", r"test result: ok", r"test result: FAILED|error\[", (r"(\d+) passed",), (r"(\d+) failed",)),
    Toolchain("pytest", r"^(python -m )?pytest", r"\d+ passed", r"\d+ (failed|error)", (r"(\d+) passed",), (r"(\d+) (?:failed|error)",)),
    Toolchain("go-test", r"^go test", r"(?m)^ok\s", r"(?m)^(--- )?FAIL", (), ()),
    Toolchain("make", r"^make\b", None, r"(?m)^make: \*\*\*", (), (), "build"),
    Toolchain("cargo-build", r"^cargo (build|check|clippy)", r"Finished", r"error(\[|:)", (), (), "build"),
)


def registry(*layers: Sequence[Toolchain]) -> list[Toolchain]:
    """Definitions by id: later layers replace earlier ones in place."""
    out: dict[str, Toolchain] = {}
    for layer in layers:
        out |= {t.id: t for t in layer}
    return list(out.values())


def definitions(text: str) -> tuple[Toolchain, ...]:
    """Toolchains of a JSON document {"toolchains": [...]}; unknown keys and patterns that do not compile are errors."""
    import json
    import re

    out = []
    for entry in json.loads(text)["toolchains"]:
        if extra := set(entry) - set(Toolchain.__dataclass_fields__):
            raise ValueError(f"unknown keys {sorted(extra)}")
        entry = {k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()}
        tool = Toolchain(**entry)
        for pattern in (tool.command, tool.success, tool.failure, tool.section, *tool.passed, *tool.failed):
            if pattern is not None:
                re.compile(pattern)
        if not set(tool.modes) <= {"sum", "first"}:
            raise ValueError(f"unknown modes {tool.modes}")
        out.append(tool)
    return tuple(out)


def graded(exit_code: Column, success: Column, failure: Column) -> Column:
    """pass, fail or unknown: failure evidence or an exit other than 0 fails; exit 0 or success evidence without either
    passes; nothing known is unknown."""
    bad, good = F.coalesce(failure, F.lit(False)), F.coalesce(success, F.lit(False))
    return F.when(bad | (F.coalesce(exit_code, F.lit(0)) != 0), "fail").when((exit_code == 0) | good, "pass").otherwise("unknown")


def summed(output: Column, patterns: Sequence[str], mode: str = "sum") -> Column:
    """The sum of all matches (or the first) of the first pattern that matches; null if none does."""
    out = []
    for p in patterns:
        found = F.regexp_extract_all(output, F.lit(p), F.lit(1))
        taken = F.slice(found, 1, 1) if mode == "first" else found
        out.append(F.when(F.size(found) > 0, F.aggregate(taken, F.lit(0).cast("long"), lambda acc, x: acc + x.try_cast("long"))))
    return F.coalesce(*out) if out else F.lit(None).cast("long")


def evaluate(runs: DataFrame, toolchains: Sequence[Toolchain] = BUILTIN) -> DataFrame:
    """runs (subject, command, output, command_exit) with tool, kind, outcome, passed, failed of the first toolchain that
    knows the command; other commands are left out."""
    command, output, code = F.col("command"), F.col("output"), F.col("command_exit")
    known = F.coalesce(*[F.when(command.rlike(t.command), F.lit(i)) for i, t in enumerate(toolchains)])
    pick = lambda f: F.element_at(F.array(*[f(t) for t in toolchains]), F.col("__t") + 1)
    hit = lambda p: output.rlike(p) if p else F.lit(False)
    rows = runs.withColumn("__t", known).where("__t IS NOT NULL")
    told = lambda t: output if t.section is None else F.regexp_replace(output, "(?s)^.*?(?=" + t.section + ")", "")
    passed = pick(lambda t: summed(told(t), t.passed, t.modes[0]))
    return rows.withColumns({
        "tool": pick(lambda t: F.lit(t.id)), "kind": pick(lambda t: F.lit(t.kind)),
        "outcome": pick(lambda t: graded(code, hit(t.success), hit(t.failure))), "passed": passed,
        "failed": F.when(passed.isNotNull(), F.coalesce(pick(lambda t: summed(told(t), t.failed, t.modes[1])), F.lit(0)))}).drop("__t")


def latest(signals: DataFrame) -> DataFrame:
    """The newest status of each (subject, key)."""
    return signals.groupBy("subject", "key").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def proofs(results: DataFrame, markers: DataFrame) -> DataFrame:
    """Per subject: passed properties, and whether proof holds. A run marker withholds every property known so far until
    it is reported again; all must have passed."""
    last = latest(results)
    marked = markers.groupBy("subject").agg(F.max("seq").alias("marker"))
    fresh = F.col("marker").isNull() | (F.col("seq") > F.col("marker"))
    return last.join(marked, "subject", "left").groupBy("subject").agg(
        F.count_if(fresh & (F.col("status") == "pass")).alias("proved"), F.count("*").alias("known"),
        F.bool_and(fresh & (F.col("status") == "pass")).alias("holds"))


def running_known(results: DataFrame) -> DataFrame:
    """How many properties each subject had reported up to each row."""
    first = F.row_number().over(Window.partitionBy("subject", "key").orderBy("seq")) == 1
    return results.withColumn("new", first.cast("int")).withColumn(
        "known", F.sum("new").over(Window.partitionBy("subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def band(signals: Column) -> Column:
    """Confidence from the number of passing signals."""
    return F.when(signals >= 3, "high").when(signals == 2, "medium").otherwise("low")


def bug_checks(bugs: DataFrame, results: DataFrame) -> DataFrame:
    """Open bugs (bug_id, test, status) against results (name, passed): fixed if the test passed, open if it failed,
    unknown if it did not run; regression tells whether any test outside the bugs failed."""
    open_ = bugs.where("status = 'open'")
    by_test = results.groupBy("name").agg(F.bool_and("passed").alias("passed"))
    outside = by_test.join(open_, F.col("name") == F.col("test"), "left_anti").agg(F.coalesce(F.bool_or(~F.col("passed")), F.lit(False)).alias("regression"))
    state = F.when(F.col("passed").isNull(), "unknown").when(F.col("passed"), "fixed").otherwise("open")
    return open_.join(by_test, F.col("name") == F.col("test"), "left").select("bug_id", "test", state.alias("outcome")).crossJoin(F.broadcast(outside))
