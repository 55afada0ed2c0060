"""Operators on the keyed registry of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import eid_hex


def point_lookup(registry: DataFrame, requests: DataFrame, key: str = "iccid_hex") -> DataFrame:
    """Each request with the state found for its key; status -7 where there is none.

    The registry's key is unique, so this is one left join.
    """
    found = registry.select(key, "state")
    return requests.join(found, key, "left").select(
        *requests.columns,
        F.when(F.col("state").isNull(), -7).otherwise(0).alias("status"),
        F.col("state"),
    )


def first_rows(df: DataFrame, capacity: int, *order: str) -> DataFrame:
    """The first ``capacity`` rows of a total order."""
    return df.orderBy(*order).limit(capacity)


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first match of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def appeared(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``after`` that ``before`` lacks."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def deleted(registry: DataFrame, delete_keys: DataFrame, keys: list[str]) -> DataFrame:
    """The registry without the given keys."""
    return registry.join(delete_keys.select(*keys).distinct(), keys, "left_anti")


def delete_status(registry: DataFrame, delete_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each delete request: 0, or -7 where the key isn't there."""
    there = registry.select(*keys).distinct().withColumn("__there", F.lit(1))
    return delete_keys.join(there, keys, "left").select(*keys, F.when(F.col("__there").isNull(), -7).otherwise(0).alias("status"))


def still_there(registry: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    return asked.join(registry.select(*keys).distinct(), keys, "left_semi")


def upsert(registry: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both; the latest row of each key stays."""
    columns = registry.columns
    both = registry.unionByName(rows)
    latest = both.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return latest.select("r.*")


def renamed(registry: DataFrame, names: DataFrame, key: str = "iccid_hex") -> DataFrame:
    """The registry with nicknames set by ``names(key, nickname)``; no event is made of it."""
    new = names.select(key, F.col("nickname").alias("__new"))
    return registry.join(new, key, "left").withColumn("nickname", F.coalesce("__new", "nickname")).drop("__new")


def chip_info(registry: DataFrame, os_version: str, capacity: int) -> DataFrame:
    """One row for each device: its identifier, constants and the number of its profiles."""
    counted = registry.groupBy("device_id").agg(F.count("*").alias("n_profiles"))
    return counted.select(
        "device_id",
        eid_hex(F.col("device_id")).alias("eid"),
        F.lit(os_version).alias("os_version"),
        F.lit(capacity).alias("capacity"),
        F.lit(0).alias("free_mem"),
        "n_profiles",
    )


def with_ordinals(registry: DataFrame, by: str, *order: str) -> DataFrame:
    """Rows with the number that a list shows beside them."""
    return registry.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
