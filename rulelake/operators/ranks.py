"""Exact values at ranks, by histograms of digits: no task holds more counters than a digit has values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit, and how 64-bit numbers become unsigned in order.
DIGIT, SIGN = 16, -(1 << 63)


def at_ranks(rows: DataFrame, value: str, wanted: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """by and, for each wanted rank (from 1, an expression over the count n), the value of that rank in its group; groups
    without values are left out, and without by there is one row.

    A round counts values by their next 16 bits from above, finds the digit in which each rank lies and goes on with the
    values that begin so; as many bits as the values span take part, so most columns need one or two rounds. Counts are
    made in each task first, and a group's 65,536 digits are what one task orders."""
    from ..plans.tables import Held, small

    keys = [f"__k{i}" for i in range(len(by))]
    v = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("long").alias("__v"))
    lo, hi = v.agg(F.min("__v"), F.max("__v")).first()
    if lo is None:
        none = v.groupBy(*keys).agg(*[F.max("__v").alias(name) for name in wanted])
        return none.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *wanted)
    bits = max(1, (hi - lo).bit_length())
    if bits < 64:
        u, back = F.col("__v") - lo, lambda x: x + lo
    else:
        u, back = F.col("__v").bitwiseXOR(F.lit(SIGN)), lambda x: x.bitwiseXOR(F.lit(SIGN))
    v = v.select(*keys, u.alias("__u"))
    shift = (bits - 1) // DIGIT * DIGIT
    above = lambda s: F.shiftrightunsigned("__u", s) if s < 64 else F.lit(0).cast("long")
    state = None
    while shift >= 0:
        digit = above(shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("__digit")
        some = v.withColumn("__prefix", above(shift + DIGIT))
        if state is not None:
            asked = small(state.df.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("__prefix").alias("__begins")).distinct())
            some = some.join(asked, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys], F.col("__prefix") == F.col("__begins")), "left_semi")
        counts = some.groupBy(*keys, "__prefix", digit).agg(F.count("*").alias("__c"))
        group = Window.partitionBy(*keys, "__prefix")
        upto = counts.withColumns({"__upto": F.sum("__c").over(group.orderBy("__digit")), "n": F.sum("__c").over(group)})
        if state is None:
            ranks = F.array(*[F.struct(F.lit(name).alias("__name"), rank.cast("long").alias("__rank")) for name, rank in wanted.items()])
            told = upto.select("*", F.inline(F.filter(ranks, lambda x: (x["__rank"] <= F.col("__upto")) & (x["__rank"] > F.col("__upto") - F.col("__c")))))
        else:
            last = small(state.df.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("__prefix").alias("__begins"), "__name", "__rank"))
            inside = (F.col("__prefix") == F.col("__begins")) & (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__c"))
            told = upto.join(last, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys], inside))
        told = told.select(*keys, "__name", (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rank"), F.shiftleft("__prefix", DIGIT).bitwiseOR(F.col("__digit")).alias("__prefix"))
        if shift and state is None:
            state = Held(told)
        elif shift:
            state.become(told)
        shift -= DIGIT
    return told.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, back(F.col("__prefix")))).alias(name) for name in wanted]).select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], *wanted)
