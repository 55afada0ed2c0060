"""Event, subscription and registry tables from the given base tables.

The mapping of base columns to device concepts is this library's own: users are
devices, ``k`` of a property object modulo the capacity is a profile slot, and
event names stand for lifecycle events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import iccid_hex
from ..schema import ALL_EVENTS, CAPACITY

#: Event name, bit, status.
EVENT_NAMES = [("signup", 1, 0), ("purchase", 2, 0), ("click", 4, 0), ("view", 256, 1), ("error", 512, -14)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_name(at: int, default: int):
    out = F.when(F.lit(False), F.lit(default))
    for row in EVENT_NAMES:
        out = out.when(F.col("event_type") == row[0], F.lit(row[at]))
    return out.otherwise(F.lit(default))


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``device_id, event_id, ts, k, slot, type, status, value, event_type``."""
    return normalized(table(spark, sf_dir, "events"))


def normalized(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("device_id"),
        "event_id",
        "ts",
        k.alias("k"),
        (k % CAPACITY).alias("slot"),
        _by_name(1, 0).cast("long").alias("type"),
        _by_name(2, 0).alias("status"),
        "value",
        "event_type",
    )


def subscriptions(spark: SparkSession) -> DataFrame:
    """A literal table of subscriptions, in the order of registration."""
    return spark.createDataFrame([(1, ALL_EVENTS), (2, 7), (3, 512), (4, 8)], "sub_id long, mask long")


def registry(events: DataFrame) -> DataFrame:
    """One row for each installed profile: its first install, its last state command and its key."""
    order = F.struct("ts", "event_id")
    command = F.col("type").isin(2, 4)
    return (
        events.groupBy("device_id", "slot")
        .agg(
            F.min(F.when(F.col("type") == 1, order)).alias("first"),
            F.max_by(F.when(F.col("type") == 2, 0).otherwise(1), F.when(command, order)).alias("state"),
            F.max(F.when(F.col("type") == 512, F.lit(True)).otherwise(False)).alias("failed"),
        )
        .where("first is not null")
        .select(
            "device_id",
            "slot",
            iccid_hex(F.col("device_id"), F.col("slot")).alias("iccid_hex"),
            F.coalesce("state", F.lit(1)).alias("state"),
            (F.col("slot") == 7).alias("is_test_profile"),
            "failed",
        )
    )
