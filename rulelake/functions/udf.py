"""Python surfaces: fact providers as table functions, lookups as joins, templates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits on one provider call.
MAX_FACTS, MAX_ARGS = 128, 32


class ProviderError(ValueError):
    """A provider that emits too much, or a reserved relation."""


def collect(provider: Callable, event: dict, reserved: Iterable[str] = (), prefixes: Iterable[str] = ("__",)) -> list[tuple[str, list[str]]]:
    """All facts that the provider emits for an event, or none and an error."""
    out: list[tuple[str, list[str]]] = []

    def emit(predicate: str, args: list) -> None:
        if predicate in set(reserved) or any(predicate.startswith(p) for p in prefixes):
            raise ProviderError(f"{predicate} is reserved")
        if len(args) > MAX_ARGS:
            raise ProviderError(f"{predicate} has more than {MAX_ARGS} arguments")
        out.append((predicate, [str(a) for a in args]))
        if len(out) > MAX_FACTS:
            raise ProviderError(f"more than {MAX_FACTS} facts")

    provider(event, emit)
    return out


def provide(events: DataFrame, provider: Callable, key: str = "id", reserved: Iterable[str] = ()) -> DataFrame:
    """Facts of a provider for each event row: key, predicate, args, error (then without facts). Runs in Arrow batches."""
    reserved = tuple(reserved)
    names = [c for c in events.columns if c != key]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, *values in zip(pdf[key], *(pdf[n] for n in names)):
                try:
                    rows += [(str(k), p, a, None) for p, a in collect(provider, dict(zip(names, values)), reserved)]
                except Exception as e:  # noqa: BLE001  the error is this event's result
                    rows.append((str(k), None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "predicate", "args", "error"])
    return events.mapInPandas(run, "key string, predicate string, args array<string>, error string")


#: Records, and bytes of their JSON, that one adapter call may give.
MAX_RECORDS, MAX_OUTPUT = 4096, 1 << 20


def adapt(captures: DataFrame, adapter: Callable[[dict], list[dict]], kinds: Iterable[str], key: str = "file", most: int = MAX_RECORDS, most_bytes: int = MAX_OUTPUT) -> DataFrame:
    """Typed records of a language pack's adapter for each row of captures (key, captures JSON): key, kind, fields, error.
    An adapter that fails, gives too much or an unknown kind gives that row's one error and no record."""
    kinds = frozenset(kinds)

    def one(text: str) -> list[tuple[str, dict]]:
        out, size = [], 0
        for record in adapter(json.loads(text)):
            size += len(json.dumps(record).encode())
            if record.get("kind") not in kinds:
                raise ProviderError(f"unknown record kind {record.get('kind')!r}")
            if len(out) >= most or size > most_bytes:
                raise ProviderError("more output than an adapter may give")
            out.append((record["kind"], {k: str(v) for k, v in record.items() if k != "kind"}))
        return out

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["captures"]):
                try:
                    rows += [(str(k), kind, fields, None) for kind, fields in one(text)]
                except Exception as e:  # noqa: BLE001  the error is this row's result
                    rows.append((str(k), None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "kind", "fields", "error"])
    return captures.mapInPandas(run, "key string, kind string, fields map<string,string>, error string")


class Lookups:
    """Lookup tables by name: rules ask for them by name, and a name that is not there is an error or (lenient) nulls."""

    def __init__(self):
        self.tables: dict[str, tuple[DataFrame, list[str]]] = {}

    def add(self, name: str, table: DataFrame, on: list[str]) -> None:
        if name in self.tables:
            raise ProviderError(f"lookup {name} exists")
        self.tables[name] = (table, on)

    def ask(self, rows: DataFrame, name: str, strict: bool = True) -> DataFrame:
        if name not in self.tables:
            if strict:
                raise ProviderError(f"no lookup {name}")
            return rows
        table, on = self.tables[name]
        return lookup(rows, table, on, strict)


def udtf_of(provider: Callable, reserved: Iterable[str] = ()):
    """The provider as a SQL table function of one JSON event."""
    from pyspark.sql.functions import udtf

    reserved = tuple(reserved)

    class Provider:
        def eval(self, event: str):
            yield from collect(provider, json.loads(event), reserved)

    return udtf(Provider, returnType="predicate string, args array<string>")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """rows with the table's columns; strict: an error for a row without an entry, else nulls."""
    found = rows.join(table.withColumn("__there", F.lit(True)), on, "left")
    if strict:
        found = found.withColumn("__there", F.when(F.col("__there").isNull(), F.raise_error(F.lit("lookup without an entry"))).otherwise(F.lit(True))).where("__there")
    return found.drop("__there")


def template(text: str, inputs: Iterable[str]):
    """Rendering of {name} fields from columns, as an expression."""
    import re

    parts, at = [], 0
    known = set(inputs)
    for m in re.finditer(r"\{(\w+)\}", text):
        if m[1] in known:
            parts += [F.lit(text[at:m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
