"""Counters that a query reports while it runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..schema import EVENT_BITS

KINDS = [0, *(b for b, _, _ in EVENT_BITS)]
COUNTS = "type long, n long, n_errors long"


def observed_types(events: DataFrame, into: str | Observation) -> DataFrame:
    """``events(type, status)`` that report rows and errors of each type on their way, as a part of whatever job reads them."""
    counters = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in KINDS]
    errors = [F.count_if((F.col("type") == k) & (F.col("status") < 0)).alias(f"e_{k}") for k in KINDS]
    return events.observe(into, *counters, *errors)


def totals(spark: SparkSession, metrics: Iterable[dict]) -> DataFrame:
    """``type, n, n_errors`` of the types that occurred, summed over reports."""
    seen = list(metrics)
    rows = [(k, sum(m[f"n_{k}"] for m in seen), sum(m[f"e_{k}"] for m in seen)) for k in KINDS]
    return spark.createDataFrame([r for r in rows if r[1]], COUNTS)


class MetricsListener(StreamingQueryListener):
    """Calls ``done(batch_id, metrics)`` for each batch of any stream that observes under ``name``."""

    def __init__(self, name: str, done: Callable[[int, dict], None]):
        self._name, self._done = name, done

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics or {}
        if self._name in seen:
            self._done(event.progress.batchId, seen[self._name].asDict())

    def onQueryTerminated(self, event) -> None:
        pass
