"""Relational operators that have no counterpart in the lifecycle domain (extensions).

Each avoids sending a hot key to one task where the operator allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import last_before, running_sum


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, carry: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are unioned and the last right row is carried forward, so there
    is one shuffle and no product of a key's rows.
    """
    values = F.struct(*carry)
    both = left.withColumn("__r", F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType)).withColumn("__side", F.lit(1)).unionByName(
        right.select(*by, at, values.alias("__r")).withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    filled = last_before(both, F.col("__r"), "__last", tuple(by), (at, "__side")).where("__side = 1")
    return filled.select(*left.columns, *(F.col("__last")[c].alias(f"asof_{c}") for c in carry))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside intervals (end excluded), by an equi join on buckets of ``width``; an interval is dealt to each bucket it touches."""
    bucket: Column = F.floor(F.col(at) / width)
    dealt = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    joined = points.withColumn("__b", bucket).join(dealt, "__b")
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def interval_counts(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, by: list[str]) -> DataFrame:
    """``by`` and ``n``, the points inside the intervals (end excluded) of each key that has any: :func:`interval_join`, counted.

    Pairs grow with the product of both sides, so none is formed.  In each bucket
    an interval has the points below its end less those below its start; a
    running sum over points and bounds in one order has both.
    """
    counted = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("__at")).agg(F.count("*").alias("__n"))
    bounds = F.inline(F.array(F.struct(F.col(start).alias("__at"), F.lit(-1).alias("__sign")), F.struct(F.col(end).alias("__at"), F.lit(1).alias("__sign"))))
    dealt = intervals.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    both = dealt.select(*by, "__b", bounds).withColumns({"__n": F.lit(0), "__side": F.lit(0)}).unionByName(
        counted.withColumns({"__b": F.floor(F.col("__at") / width), "__side": F.lit(1)}), allowMissingColumns=True
    )
    below = running_sum(both, F.col("__n"), "__below", ("__b",), ("__at", "__side")).where("__side = 0")
    return below.groupBy(*by).agg(F.sum(F.col("__sign") * F.col("__below")).alias("n")).where("n > 0")


def sessions(events: DataFrame, by: str, at: str, gap_us: int) -> DataFrame:
    """Events with the number of their session: a longer gap than ``gap_us`` starts a new one."""
    micros, order = F.unix_micros(F.col(at).cast("timestamp")), (at, "event_id")
    known = last_before(events, F.struct(micros.alias("us")), "__before", (by,), order)
    starts = F.when(micros - F.col("__before.us") <= gap_us, 0).otherwise(1)
    return running_sum(known, starts, "session", (by,), order).drop("__before")
