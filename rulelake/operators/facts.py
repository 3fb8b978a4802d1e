"""Fact tables: scans, positional filters, identity rules and snapshot checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PolicyError

#: Limits on one item; rows beyond them are reported, never cut.
MAX_STRING, MAX_ARGS = 65_536, 256


def by_predicate(facts: DataFrame, predicate: str) -> DataFrame:
    return facts.where(F.col("predicate") == predicate)


def by_predicates(facts: DataFrame, predicates: Iterable[str]) -> DataFrame:
    """Facts of any of the predicates, one for each id, by id."""
    return facts.where(F.col("predicate").isin(*predicates)).dropDuplicates(["id"]).orderBy("id")


def by_id(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.where(F.col("id") == fact_id)


def snapshot(facts: DataFrame) -> DataFrame:
    return facts.orderBy("id")


def matching(facts: DataFrame, predicate: str, at: Iterable[tuple[int, str]] = ()) -> DataFrame:
    """Facts whose argument at each position has that value; a position past the end never matches. From a stored layout
    only the row groups that can hold the first argument are read."""
    from ..sources import layout

    rows = by_predicate(facts, predicate)
    for i, value in at:
        if i == 0 and layout.FIRST in facts.columns:
            rows = rows.where(layout.first_is(value))
        rows = rows.where(F.try_element_at("args", F.lit(i + 1)) == value)
    return rows


def matching_ids(facts: DataFrame, predicate: str, at: Iterable[tuple[int, str]] = ()) -> DataFrame:
    return matching(facts, predicate, at).select("id")


def conflicts(facts: DataFrame) -> DataFrame:
    """Ids with different contents."""
    return facts.groupBy("id").agg(F.count_distinct("predicate", "args").alias("contents")).where("contents > 1").select("id")


def merged(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables: asserting an equal fact again changes nothing (the first source stays), another content under
    the same id is an error."""
    both = facts.withColumn("__n", F.lit(0)).unionByName(more.withColumn("__n", F.lit(1)))
    if not (bad := conflicts(both)).isEmpty():
        raise PolicyError(f"fact {bad.first()[0]} is asserted with another content")
    first = F.min_by(F.struct(*facts.columns), "__n").alias("f")
    return both.groupBy(F.col("id").alias("__id")).agg(first).select("f.*")


def validate(host: DataFrame, extensions: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """The snapshot of both, if no extension uses a reserved predicate and no id occurs twice."""
    bad = extensions.where(F.col("predicate").isin(*list(reserved) or [""])).select("predicate").limit(1).collect()
    if bad:
        raise PolicyError(f"extension facts may not use {bad[0][0]}")
    both = host.unionByName(extensions)
    twice = both.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise PolicyError(f"fact id {twice[0][0]} occurs twice")
    return both


def oversized(facts: DataFrame) -> DataFrame:
    """Facts beyond the limits of one item."""
    return facts.where((F.size("args") > MAX_ARGS) | F.exists("args", lambda a: F.octet_length(a) > MAX_STRING) | (F.octet_length("predicate") > MAX_STRING))


def relation(facts: DataFrame, predicate: str, columns: list[str]) -> DataFrame:
    """A relation as a table: the facts of one predicate and arity."""
    rows = by_predicate(facts, predicate).where(F.size("args") == len(columns))
    return rows.select("id", *[F.col("args")[i].alias(c) for i, c in enumerate(columns)])


def facts_of(rows: DataFrame, predicate: str, columns: list[str], prefix: str | None = None, source: str | None = None) -> DataFrame:
    """Facts of one predicate from a table's columns, with ids from their values."""
    from ..functions.text import escaped

    values = [F.col(c).cast("string") for c in columns]
    ident = F.concat_ws(":", F.lit(prefix or predicate), *[escaped(v) for v in values])
    return rows.select(ident.alias("id"), F.lit(predicate).alias("predicate"), F.array(*values).alias("args"),
                       F.lit(0).cast("long").alias("timestamp"), F.lit(source).cast("string").alias("source"))
