"""The registry at any time: intervals in which profiles were installed, snapshots, and joins with them.

``install`` opens an interval and ``delete`` closes it; an install of an
installed profile and a delete of an absent one change nothing.  Intervals hold
their start and not their end, so two snapshots of one table of intervals differ
by what was installed and deleted in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import DELETE, INSTALL
from .scan import IN_ORDER, last_before

KEY = ("device_id", "slot")


def validity(events: DataFrame) -> DataFrame:
    """``device_id, slot, valid_from, valid_to`` of each stay of a profile in the registry; ``valid_to`` is null while it lasts."""
    commands = events.where(F.col("type").isin(INSTALL, DELETE)).select(*KEY, "ts", "event_id", "type")
    turns = last_before(commands, F.col("type"), "prior", KEY)
    # Commands that change nothing go; then each install is followed by its delete, if any.
    turns = turns.where(F.coalesce(F.col("prior") != F.col("type"), F.col("type") == INSTALL))
    ended = last_before(turns, F.struct("type", "ts"), "next", KEY, backwards=True)
    return ended.where(F.col("type") == INSTALL).select(*KEY, F.col("ts").alias("valid_from"), F.col("next.ts").alias("valid_to"))


def holds_at(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def snapshot(intervals: DataFrame, at: Column) -> DataFrame:
    """The keys that are installed at an instant; both bounds reach the scan of a stored table of intervals."""
    return intervals.where(holds_at(at)).select(*KEY)


def changes_between(intervals: DataFrame, first: Column, second: Column) -> DataFrame:
    """Keys with ``change`` 1 (in the second snapshot only) or -1 (in the first only), in one pass over the intervals."""
    marks = intervals.where(holds_at(first) | holds_at(second)).groupBy(*KEY).agg(F.max(holds_at(first).cast("int")).alias("a"), F.max(holds_at(second).cast("int")).alias("b"))
    return marks.where("a <> b").select(*KEY, (F.col("b") - F.col("a")).alias("change"))


def installed_when(events: DataFrame, commands: DataFrame) -> DataFrame:
    """``events`` with ``installed_at``, whether their profile was in the registry just before them; a temporal join by one scan.

    Events and commands are laid into one order by time and id, so no key's
    events meet all of its intervals.  An event that is a command itself stands
    before that command, so it doesn't see its own effect.
    """
    turns = commands.where(F.col("type").isin(INSTALL, DELETE)).select(*KEY, "ts", "event_id", F.col("type").alias("turn"))
    both = events.withColumn("turn", F.lit(None).cast("long")).withColumn("__commands", F.lit(False)).unionByName(turns.withColumn("__commands", F.lit(True)), allowMissingColumns=True)
    seen = last_before(both, F.col("turn"), "before", KEY, (*IN_ORDER, "__commands"))
    return seen.where("NOT __commands").withColumn("installed_at", F.coalesce(F.col("before") == INSTALL, F.lit(False))).drop("turn", "before", "__commands")
