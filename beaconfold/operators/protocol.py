"""Which step of a sequence of events breaks the lifecycle's protocol.

An event maps the state before it to the state after it or to an error, so a
stretch of events is a table of all start states: where each leads, and the
first step that breaks the protocol on the way.  Such tables compose, and
composing is associative; so segments of a key (cut by time, of bounded size)
are folded on their own and their tables are composed in order.  No task sees
all events of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import DELETE, DISABLE, ENABLE, INSTALL
from .scan import cuts_up_to, time_cuts

PROGRESS, FAILED = 256, 512
ABSENT, LOADING, READY, ACTIVE = range(4)

#: (state, event) to state; what isn't here breaks the protocol.
STEPS = {
    (ABSENT, INSTALL): LOADING,
    (LOADING, PROGRESS): LOADING,
    (LOADING, FAILED): ABSENT,
    (LOADING, ENABLE): ACTIVE,
    (LOADING, DISABLE): READY,
    (READY, ENABLE): ACTIVE,
    (READY, DELETE): ABSENT,
    (READY, FAILED): READY,
    (ACTIVE, DISABLE): READY,
    (ACTIVE, PROGRESS): ACTIVE,
    (ACTIVE, FAILED): ACTIVE,
    (ACTIVE, DELETE): ABSENT,
}
SEGMENT_ROWS = 100_000  #: events of a segment, which are folded as one array


def _next(state: Column, kind: Column) -> Column:
    """The state after an event, -1 where the event breaks the protocol."""
    out = F.lit(-1)
    for (s, k), to in STEPS.items():
        out = F.when((state == s) & (kind == k), to).otherwise(out)
    return out


def _folded(events: Column, start: int) -> Column:
    """``state, broken`` after the sorted ``events``; once broken, a sequence stays as it is."""

    def step(acc: Column, x: Column) -> Column:
        to = _next(acc["state"], x["type"])
        bad = acc["broken"].isNull() & (to < 0)
        moved = F.when(acc["broken"].isNull() & (to >= 0), to).otherwise(acc["state"])
        return F.struct(moved.alias("state"), F.when(bad, x["event_id"]).otherwise(acc["broken"]).alias("broken"))

    return F.aggregate(events, F.struct(F.lit(start).alias("state"), F.lit(None).cast("long").alias("broken")), step)


def stretches(events: DataFrame, by: tuple[str, ...], segment_rows: int | None = None) -> DataFrame:
    """``by, segment, table, n``: for each start state the end state and first broken step of each segment."""
    known = events.where(F.col("type").isin(sorted({k for _, k in STEPS})))
    cuts = time_cuts(known, "ts", segment_rows or SEGMENT_ROWS)
    segment = cuts_up_to(cuts, F.unix_micros(F.col("ts").cast("timestamp")))
    rows = known.select(*by, segment.alias("segment"), F.struct("ts", "event_id", "type").alias("x"))
    sorted_ = rows.groupBy(*by, "segment").agg(F.array_sort(F.collect_list("x")).alias("events"))
    return sorted_.select(*by, "segment", F.array(*(_folded(F.col("events"), s) for s in (ABSENT, LOADING, READY, ACTIVE))).alias("table"), F.size("events").cast("long").alias("n"))


def first_broken_steps(events: DataFrame, by: tuple[str, ...] = ("device_id", "slot"), segment_rows: int | None = None) -> DataFrame:
    """``by, n_steps, end_state, broken_event_id`` of each key; the id is null where all its events keep to the protocol."""

    def compose(acc: Column, x: Column) -> Column:
        through = F.element_at(x["table"], acc["state"] + 1)
        return F.struct(
            F.when(acc["broken"].isNull(), through["state"]).otherwise(acc["state"]).alias("state"),
            F.coalesce(acc["broken"], through["broken"]).alias("broken"),
        )

    tables = stretches(events, by, segment_rows).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("segment", "table"))).alias("parts"), F.sum("n").alias("n_steps"))
    end = F.aggregate("parts", F.struct(F.lit(ABSENT).alias("state"), F.lit(None).cast("long").alias("broken")), compose)
    return tables.withColumn("end", end).select(*by, "n_steps", F.col("end.state").alias("end_state"), F.col("end.broken").alias("broken_event_id"))
