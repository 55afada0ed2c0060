"""Operations of devices in a stream: in flight, ended, timed out; repeated and late ends; changing subscriptions.

An operation starts with an install and ends with the first enable or error of
its slot within a limit.  Devices are dealt to shards by their hash, and each
shard has keyed state (``transformWithState`` over a state store): events that
wait until the watermark has passed them, so that they count in the order of
time whatever their arrival is, and the operations in flight.  Event-time timers
wake a shard when the watermark passes its next event or the deadline of an
operation, so a timeout needs no later event of the device.  A call for each
device would cost more than its events do, so a call serves a shard.  State is
dropped with the operation; a shard holds the events of the watermark's delay
and of a batch and its operations in flight, and writes them anew when it wakes;
``maxFilesPerTrigger`` bounds a batch.  Events behind the watermark are dropped,
as in all operators here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "device_id long, slot int, event_id long, took_us long, status int"
OK, TIMEOUT = 0, -11
SHARDS = 1024  #: groups of devices with a state of their own; a checkpoint holds for one number
ROWS = ["device_id", "us", "event_id", "slot", "type"]


@contextmanager
def keyed_state(spark: SparkSession):
    """State stores that keyed state needs; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(waiting: list[tuple], in_flight: list[tuple], now_us: int, start: int, limit_us: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """What events up to ``now_us`` lead to: results, events that still wait, operations that stay in flight.

    ``waiting`` are (us, event_id, slot, type), ``in_flight`` (us, event_id, slot);
    results are (slot, event_id, took_us, status).  A slot is any key of one
    device's slot.
    """
    out, rest, flying = [], [x for x in waiting if x[0] > now_us], {}
    for us, event_id, slot in in_flight:
        flying.setdefault(slot, []).append((us, event_id))
    for us, event_id, slot, kind in sorted(x for x in waiting if x[0] <= now_us):
        if kind == start:
            flying.setdefault(slot, []).append((us, event_id))
            continue
        for began, operation in flying.pop(slot, ()):
            late = us - began > limit_us
            out.append((slot, operation, None if late else us - began, TIMEOUT if late else OK))
    left = [(us, event_id, slot) for slot, begun in flying.items() for us, event_id in begun]
    out += [(slot, operation, None, TIMEOUT) for us, operation, slot in left if us + limit_us < now_us]
    return out, rest, [x for x in left if x[0] + limit_us >= now_us]


class Operations(StatefulProcessor):
    """Ends and timeouts of the operations of a shard's devices.

    State is a list of blocks of ``ROWS`` as 64-bit integers: events that wait,
    and starts in flight, which have waited.
    """

    def __init__(self, start: int, limit_us: int):
        self.start, self.limit_us = start, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary, in_flight boolean")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pdf[ROWS].to_numpy("int64") for pdf in rows if len(pdf)]
        if new:
            self.held.appendList([(x.tobytes(), False) for x in new])
            self._wake(min(int(x[:, 1].min()) for x in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, flying = [], []
        for block, begun in self.held.get():
            for device, us, event_id, slot, kind in np.frombuffer(block, "int64").reshape(-1, len(ROWS)).tolist():
                if begun:
                    flying.append((us, event_id, (device, slot)))
                else:
                    waiting.append((us, event_id, (device, slot), kind))
        out, rest, flying = settled(waiting, flying, now, self.start, self.limit_us)
        self._hold([(d, us, e, s, k) for us, e, (d, s), k in rest], [(d, us, e, s, self.start) for us, e, (d, s) in flying])
        if rest:
            self._wake(min(rest)[0])
        if flying:
            self._wake(min(flying)[0] + self.limit_us + 1)
        if out:
            done = pd.DataFrame([(*slot, *x) for slot, *x in out], columns=["device_id", "slot", "event_id", "took_us", "status"])
            yield done.assign(took_us=pd.array([x[2] for x in out], dtype="Int64"))

    def _hold(self, waiting: list[tuple], flying: list[tuple]) -> None:
        blocks = [(np.array(rows, "int64").tobytes(), begun) for rows, begun in ((waiting, False), (flying, True)) if rows]
        self.held.put(blocks) if blocks else self.held.clear()

    def close(self) -> None:
        pass


def operations(events: DataFrame, start: int, ends: list[int], limit_us: int, delay: str, shards: int | None = None) -> DataFrame:
    """``device_id, slot, event_id, took_us, status`` of each operation once it has ended or is overdue.

    ``events`` is a stream with timestamps; it counts as complete up to ``delay``
    before its latest event.  Run it under :func:`keyed_state`.  Events without a
    device, slot or time have no operation.
    """
    own = events.where(F.col("type").isin([start, *ends]) & F.col("slot").isNotNull() & F.col("device_id").isNotNull() & F.col("ts").isNotNull())
    rows = own.withWatermark("ts", delay).select(F.pmod(F.hash("device_id"), F.lit(shards or SHARDS)).alias("shard"), "device_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "slot", "type")
    return rows.groupBy("shard").transformWithStateInPandas(Operations(start, limit_us), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def ends_once(deliveries: DataFrame, ends: list[int], delay: str) -> DataFrame:
    """Ends of operations, each once however often it is delivered within ``delay``; ends behind the watermark go."""
    own = deliveries.where(F.col("type").isin(ends)).withWatermark("ts", delay)
    return own.dropDuplicatesWithinWatermark(["event_id"]).select("device_id", "slot", "event_id")


def deliveries(events: DataFrame, leases: DataFrame, lease: str, delay: str) -> DataFrame:
    """``event_id, sub_id`` of a stream of events and a stream of subscriptions, by a join on time.

    A subscription is a chain of ``leases(sub_id, mask, since, until)`` of at most
    ``lease`` each, so subscribing adds leases and unsubscribing ends them.  Both
    sides have a watermark, and an event lies between ``until - lease`` and
    ``until`` of its lease, so Spark drops the state of both sides.
    """
    bit = F.explode(F.expr("filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), x -> (x & mask) <> 0)")).alias("bit")
    held = leases.withWatermark("until", delay).select("sub_id", "since", "until", bit)
    seen = events.select("event_id", "ts", "type").withWatermark("ts", delay)
    meets = (F.col("type") == F.col("bit")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until")) & (F.col("until") <= F.col("ts") + F.expr(f"interval {lease}"))
    return seen.join(held, meets).select("event_id", "sub_id")


def leases_of(subscriptions: DataFrame, horizon: str, days: int = 1) -> DataFrame:
    """Leases of ``days`` each for ``subscriptions(sub_id, mask, since, until)``; one without end is renewed up to ``horizon``."""
    end = F.coalesce("until", F.lit(horizon).cast("timestamp"))
    starts = F.explode(F.filter(F.expr(f"sequence(since, __end, interval {days} days)"), lambda s: s < F.col("__end")))
    rows = subscriptions.withColumn("__end", end).where("since < __end").withColumn("__start", starts)
    return rows.select("sub_id", "mask", F.col("__start").alias("since"), F.least(F.col("__start") + F.expr(f"interval {days} days"), "__end").alias("until"))
