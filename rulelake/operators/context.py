"""Context packing under budgets, and capsules with leases."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A token is about so many bytes.
BYTES_PER_TOKEN = 3
#: Limits of capsule stores: a record, all records, their number, and slots kept for urgent ones.
RECORD_BYTES, STORE_BYTES, MAX_CAPSULES, RESERVED, URGENT = 8_192, 262_144, 256, 32, 50


def estimated_tokens(size: int) -> int:
    return -(-size // BYTES_PER_TOKEN)


def admit(items: Sequence[tuple], max_bytes: int, max_tokens: int | None, ceilings: dict[str, int], nudge: str = "nudge", exempt: Sequence[str] = ("rule",)) -> list[str | None]:
    """For items (kind, size, own limit) in order, None if admitted or why not. An item's own limit stands for its kind's
    ceiling; exempt kinds have no other bound. An item that does not fit does not stop later ones. In a second pass those
    that a ceiling left out may use what is left of the shared budget; one that only the nudges' bytes keep out is
    displaced by them."""
    used, by_kind = 0, dict.fromkeys({k for k, _, _ in items}, 0)
    out: list[str | None] = []

    def shared(size: int) -> str | None:
        if size > max_bytes:
            return "byte_capacity"
        return "token_capacity" if max_tokens is not None and estimated_tokens(size) > max_tokens else None

    def refused(kind: str, size: int, limit: int | None) -> str | None:
        if limit is not None and by_kind[kind] + size > limit:
            return "kind_ceiling"
        return None if kind in exempt else shared(used + size)

    for kind, size, own in items:
        why = refused(kind, size, ceilings.get(kind) if own is None else own)
        if why is None:
            used, by_kind[kind] = used + size, by_kind[kind] + size
        out.append(why)
    for n, (kind, size, own) in enumerate(items):
        if out[n] == "kind_ceiling":
            why = refused(kind, size, own)
            if why is None:
                used, by_kind[kind] = used + size, by_kind[kind] + size
            elif why != "kind_ceiling" and by_kind.get(nudge) and shared(used + size - by_kind[nudge]) is None:
                why = "displaced_by_nudge"
            out[n] = why
    return out


def pack(items: DataFrame, max_bytes: int, max_tokens: int | None, ceilings: dict[str, int] | None = None, by: Sequence[str] = ("group",)) -> DataFrame:
    """items (group, ord, kind, stable_id, body, max_bytes) with admitted and omitted; one greedy pass a group. A group is
    what one context is offered, which hosts bound; there may be any number of groups."""
    ceilings = ceilings or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "stable_id"])
        rows = [(k, int(n), None if pd.isna(m) else int(m)) for k, n, m in zip(pdf["kind"], pdf["size"], pdf["max_bytes"])]
        why = admit(rows, max_bytes, max_tokens, ceilings)
        return pdf.assign(admitted=[w is None for w in why], omitted=why)
    sized = items.withColumn("size", F.octet_length("body").cast("long")).select(*by, "ord", "kind", "stable_id", "size", "max_bytes")
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    schema = StructType([*sized.schema.fields, StructField("admitted", BooleanType()), StructField("omitted", StringType())])
    return sized.groupBy(*by).applyInPandas(run, schema)


def nudge_order(items: DataFrame) -> DataFrame:
    """Priority descending, smaller bodies first, then id."""
    return items.orderBy(F.desc("priority"), F.octet_length("body"), "stable_id")


def capsule_order(capsules: DataFrame) -> DataFrame:
    return capsules.orderBy(F.desc("priority"), "emitted_at")


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """An ordered table with each row's place from 1: rows are counted by partition, so that none of them orders all."""
    from pyspark.sql import Window

    told = ordered.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    from ..plans.tables import cut

    told = cut(told)  # the ids must not change between the two uses
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = told.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return told.join(F.broadcast(base), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__base") + 1).drop("__part", "__at", "__first", "__base")


def eligible(capsules: DataFrame, sid: str, now: int) -> DataFrame:
    """Capsules that may be shown now: not expired, acknowledged or leased, and of this session unless persistent."""
    alive = F.col("expires_at").isNull() | (F.lit(now) <= F.col("expires_at"))
    free = F.col("lease_until").isNull() | (F.lit(now) >= F.col("lease_until"))
    mine = (F.col("lifecycle") == "persistent") | (F.col("session_id") == sid)
    return capsules.where(alive & ~F.coalesce("acknowledged", F.lit(False)) & free & mine)


def leased(capsules: DataFrame, ids: DataFrame, token: str, until: int) -> DataFrame:
    """The store with a lease on these ids."""
    marked = capsules.join(ids.select("id", F.lit(True).alias("__mine")).distinct(), "id", "left")
    own = F.coalesce("__mine", F.lit(False))
    return marked.withColumns({"lease_until": F.when(own, F.lit(until)).otherwise(F.col("lease_until")),
                               "lease_token": F.when(own, F.lit(token)).otherwise(F.col("lease_token"))}).drop("__mine")


def acknowledged(capsules: DataFrame, token: str) -> DataFrame:
    """The store in which the lease's capsules are done: those for the next interaction go, others are marked."""
    own = F.col("lease_token").eqNullSafe(F.lit(token))
    return capsules.where(~(own & (F.col("lifecycle") == "next_interaction"))).withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)) | own)


def emit(store: Sequence[dict], new: Sequence[dict]) -> list[tuple[str, str]]:
    """(id, outcome) of each new capsule in order: stored, replaced, or why it is refused."""
    held = {c["id"]: c for c in store}
    total, out = sum(len(c["body"].encode()) for c in store), []
    for c in new:
        size, old = len(c["body"].encode()), held.get(c["id"])
        grown = total + size - (len(old["body"].encode()) if old else 0)
        if old and old["emitted_by"] != c["emitted_by"]:
            out.append((c["id"], "owner_conflict"))
        elif size > RECORD_BYTES:
            out.append((c["id"], "record_too_large"))
        elif grown > STORE_BYTES:
            out.append((c["id"], "store_full"))
        elif not old and len(held) >= MAX_CAPSULES - (0 if c["priority"] >= URGENT else RESERVED):
            out.append((c["id"], "no_slot"))
        else:
            out.append((c["id"], "replaced" if old else "stored"))
            held[c["id"]], total = c, grown
    return out


def emitted(held: DataFrame, new: DataFrame) -> DataFrame:
    """emit() for many stores: held capsules (store, id, emitted_by, size) and new ones (store, ord, id, emitted_by, size,
    priority) with their outcome. A store is bounded by its limits and is one row with its capsules; rows go through
    Python by the batch."""
    key = dict(new.dtypes)["store"]
    shape = "array<struct<" + ", ".join(f"{c}: {t}" for c, t in [*new.select("ord", "id").dtypes, ("outcome", "string")]) + ">>"
    stored = held.groupBy(F.col("store").alias("__store")).agg(F.collect_list(F.struct("id", "emitted_by", "size")).alias("old"))
    fresh = new.groupBy("store").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").isNull().alias("last"), "ord", F.col("id").isNull().alias("after"), "id", "emitted_by", "size", "priority"))).alias("fresh"))
    body = lambda r: {"id": r["id"], "emitted_by": r["emitted_by"], "body": "x" * min(r["size"], RECORD_BYTES + 1)}

    def run(batches):
        for batch in batches:
            told = []
            for old, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                outcome = emit([body(r) for r in old or ()], [{**body(r), "priority": r["priority"]} for r in some])
                told.append([{"ord": r["ord"], "id": r["id"], "outcome": o} for r, (_, o) in zip(some, outcome)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, result)], ["store", "told"])
    both = fresh.join(stored, F.col("store").eqNullSafe(F.col("__store")), "left").select("store", "old", "fresh")
    result = to_arrow_type(StructType.fromDDL(f"told {shape}")["told"].dataType)
    return both.mapInArrow(run, f"store {key}, told {shape}").select("store", F.inline("told"))
