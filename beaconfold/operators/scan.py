"""Running values in the order of a key's rows, without one task for a hot key.

A window over a key puts all of the key's rows in one task.  Here rows are cut
into *segments* by quantiles of time over the whole table, so a segment of a key
has about ``SEGMENT_ROWS`` rows at most, however many of all rows the key has
(rows of one instant stay together).  The scan has two levels: windows run over
(key, segment), each segment leaves one carry, carries are scanned by key (as
many rows as the key has segments) and joined back on (key, segment).  That join
has the windows' partitioning, so the rows aren't shuffled again.

A table of one segment takes the plain window, with the same result.  Null keys
are a key, null times come first.  Rows that tie in the whole order have no
defined order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 1_000_000
MOST_SEGMENTS = 10_000  #: cuts that a plan holds
IN_ORDER = ("ts", "event_id")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def time_cuts(rows: DataFrame, at: str, segment_rows: int | None = None) -> list[int]:
    """Instants (microseconds) that part the rows into segments of about equal size; none for a small table."""
    n = min(MOST_SEGMENTS, -(-rows.count() // (segment_rows or SEGMENT_ROWS)))
    if n <= 1:
        return []
    shares = [k / n for k in range(1, n)]
    return sorted(set(rows.agg(F.percentile_approx(_micros(at), shares, max(10_000, 10 * n)).alias("p")).first().p or []))


def cuts_up_to(cuts: list[int], at: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``at``, by halving."""
    if not cuts:
        return F.lit(0)
    values, steps = F.array(*map(F.lit, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= at, n + step).otherwise(n))


def _in_segments(rows: DataFrame, cuts: list[int], at: str, by: tuple[str, ...], value: Column) -> tuple[DataFrame, list[str], list[str]]:
    """``rows`` with their segment and value, and the names of columns that stand for their key, and for key and segment.

    These have no nulls (a text and whether there is a key), so plain equality
    joins them and windows and joins agree on how rows are dealt.
    """
    keys = [name for i in range(len(by)) for name in (f"__k{i}", f"__n{i}")]
    columns = {f"__k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(by)} | {f"__n{i}": F.col(k).isNull() for i, k in enumerate(by)}
    return rows.withColumns(columns | {"__segment": cuts_up_to(cuts, _micros(at)), "__value": value}), keys, [*keys, "__segment"]


def running_sum(rows: DataFrame, value: Column, name: str, by: tuple[str, ...], order: tuple[str, ...] = IN_ORDER) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` up to and with each row in its key's order."""
    upto = (Window.unboundedPreceding, 0)
    cuts = time_cuts(rows, order[0])
    if not cuts:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)).cast("long"))
    cut, key, keys = _in_segments(rows, cuts, order[0], by, value)
    local = cut.withColumn("__local", F.sum("__value").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    earlier = Window.partitionBy(*key).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*keys).agg(F.sum("__value").alias("__sum")).select(*keys, F.sum("__sum").over(earlier).alias("__carry"))
    both = local.join(carry, keys, "left")
    return both.withColumn(name, (F.col("__local") + F.coalesce("__carry", F.lit(0))).cast("long")).drop(*keys, "__value", "__local", "__carry")


def last_before(rows: DataFrame, value: Column, name: str, by: tuple[str, ...], order: tuple[str, ...] = IN_ORDER, backwards: bool = False) -> DataFrame:
    """``rows`` with ``name``, the last ``value`` that isn't null before each row in its key's order (``backwards``: the first one after it)."""
    along = [F.desc(c) for c in order] if backwards else list(order)
    before = (Window.unboundedPreceding, -1)
    cuts = time_cuts(rows, order[0])
    if not cuts:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*along).rowsBetween(*before)))
    cut, key, keys = _in_segments(rows, cuts, order[0], by, value)
    local = cut.withColumn("__local", F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*along).rowsBetween(*before)))
    edge = F.min_by if backwards else F.max_by
    seen = cut.groupBy(*keys).agg(edge("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__edge"))
    outer = Window.partitionBy(*key).orderBy(F.desc("__segment") if backwards else "__segment").rowsBetween(*before)
    carry = seen.select(*keys, F.last("__edge", ignorenulls=True).over(outer).alias("__carry"))
    both = local.join(carry, keys, "left")
    return both.withColumn(name, F.coalesce("__local", "__carry")).drop(*keys, "__value", "__local", "__carry")
