"""The batch fold of lifecycle commands: at most one active profile for each device.

Rules: enabling a profile that isn't installed does nothing; enabling one
deactivates all others; disabling counts only for the active one; installing an
installed profile does nothing; deleting deactivates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import last_before

INSTALL, ENABLE, DISABLE, DELETE = 1, 2, 4, 8
KEY = ("device_id", "slot")


def with_installed(events: DataFrame) -> DataFrame:
    """Whether the event's profile is installed just before the event."""
    turns = last_before(events, F.when(F.col("type").isin(INSTALL, DELETE), F.col("type")), "installed", KEY)
    return turns.withColumn("installed", F.coalesce(F.col("installed") == INSTALL, F.lit(False)))


def active_profiles(events: DataFrame) -> DataFrame:
    """``device_id, slot`` of the active profiles: the device's last effective enable, unless it was disabled or deleted since."""
    seen = with_installed(events)
    at = F.struct("ts", "event_id")
    last = seen.where((F.col("type") == ENABLE) & F.col("installed")).groupBy("device_id").agg(F.max_by("slot", at).alias("slot"), F.max(at).alias("since"))
    ended = seen.where(F.col("type").isin(DISABLE, DELETE)).select("device_id", "slot", at.alias("at"))
    later = (last["device_id"] == ended["device_id"]) & (last["slot"] == ended["slot"]) & (ended["at"] > last["since"])
    return last.join(ended, later, "left_anti").select("device_id", "slot")


def latest_state(events: DataFrame) -> DataFrame:
    """The last command of each profile as its state (0 enabled, 1 disabled)."""
    at = F.struct("ts", "event_id")
    commands = events.where(F.col("type").isin(ENABLE, DISABLE))
    return commands.groupBy("device_id", "slot").agg(F.max_by(F.when(F.col("type") == ENABLE, 0).otherwise(1), at).alias("state"), F.count("*").alias("n_commands"))


def timed_out(events: DataFrame, start: int, ends: list[int], limit_us: int) -> DataFrame:
    """Started operations with status 0, or -11 where no end follows within ``limit_us``."""
    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ended = last_before(timed, F.when(F.col("type").isin(ends), F.col("us")), "end_us", KEY, backwards=True)
    started = ended.where(F.col("type") == start)
    late = F.col("end_us").isNull() | (F.col("end_us") - F.col("us") > limit_us)
    return started.select("device_id", "slot", "event_id", (F.col("end_us") - F.col("us")).alias("took_us"), F.when(late, -11).otherwise(0).alias("status"))


def completions(events: DataFrame, start: int, ends: list[int], limit_us: int) -> DataFrame:
    """Every end of an operation: ``counted`` if it is the first after a start and within ``limit_us``, else it is late or has no operation, and ignored."""
    timed = events.where(F.col("type").isin([start, *ends])).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ended = last_before(timed, F.struct("type", "us"), "prior", KEY).where(F.col("type").isin(ends))
    in_flight = F.coalesce(F.col("prior.type") == start, F.lit(False)) & F.coalesce(F.col("us") - F.col("prior.us") <= limit_us, F.lit(False))
    return ended.select("device_id", "slot", "event_id", in_flight.alias("counted"))
