"""Log records: filtering, formatting and the newest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import log_line


def up_to_level(records: DataFrame, level: int) -> DataFrame:
    return records.where(F.col("level") <= level)


def shown_in_panel(records: DataFrame) -> DataFrame:
    """Warnings and errors, with a flag that is false for errors."""
    return up_to_level(records, 2).withColumn("ok", F.col("level") != 1)


def formatted(records: DataFrame, detail: bool = False) -> DataFrame:
    return records.withColumn("line", log_line(F.col("ts"), F.col("level"), F.col("module"), F.col("message"), detail))


def newest(records: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` records, newest first."""
    return records.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def failures(lines: DataFrame, mark: str = "[!!]") -> DataFrame:
    return lines.where(F.contains("line", F.lit(mark)))
