"""Streaming counterparts: routing, the stateful lifecycle, operations in flight and counters.

Streams read the given tables where they lie, run to the end of what is there
(``availableNow``), and write to Parquet with a checkpoint.  A caller that names
the folder (``base``) goes on where its last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import consents, fanout_by_bits
from ..operators.lifecycle import DELETE, DISABLE, ENABLE, INSTALL
from ..sources.tables import normalized, subscriptions
from . import metrics, operations
from .folders import children, exists, remove, source_folder, stream_dir

FAILED = 512


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events as a stream, with timestamps that may carry watermarks; the table is read where it lies."""
    table = f"{sf_dir}/events.parquet"
    folder, names = source_folder(spark, table)
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalized(reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))


def drained(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """What ``stream`` has written once its source is read to the end.

    With a ``base`` folder of the caller's, a later call goes on where the last
    one stopped and returns all that was written since the first.
    """
    spark = stream.sparkSession
    base = stream_dir(spark, base)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of the stream's events to a static table of subscriptions."""
    routed = fanout_by_bits(event_stream(spark, sf_dir).select("event_id", "type"), subscriptions(spark))
    return drained(routed.select("event_id", "sub_id"))


DELAY, LIMIT_US = "1 hour", 86_400_000_000


def stream_operations(spark: SparkSession, sf_dir: str, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Installs that ended, or timed out after a day, up to the watermark."""
    with operations.keyed_state(spark):
        return drained(operations.operations(event_stream(spark, sf_dir, files_per_batch), INSTALL, [ENABLE, FAILED], LIMIT_US, DELAY), base=base)


def stream_ends(spark: SparkSession, sf_dir: str, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Ends of a stream that delivers every event twice."""
    twice = event_stream(spark, sf_dir, files_per_batch).unionByName(event_stream(spark, sf_dir, files_per_batch))
    return drained(operations.ends_once(twice, [ENABLE, FAILED], DELAY), base=base)


def stream_consents(spark: SparkSession, sf_dir: str, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Consents of a stream that delivers every prompt twice; each is answered once, also after a restart.

    Installs with an odd ``k`` stand for prompts that require consent.
    """
    twice = event_stream(spark, sf_dir, files_per_batch).unionByName(event_stream(spark, sf_dir, files_per_batch))
    prompts = twice.where(F.col("type") == INSTALL).withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])
    return drained(consents(prompts.withColumn("consent_required", F.col("k") % 2 == 1)), base=base)


def stream_subscriptions(spark: SparkSession, sf_dir: str, subs: DataFrame, horizon: str, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Deliveries to subscriptions that begin and end, both sides streams.  ``subs`` is a table of a few subscriptions."""
    at = f"{stream_dir(spark, base)}/leases"
    if not exists(spark, at):
        operations.leases_of(subs, horizon).write.parquet(at)
    leases = spark.readStream.schema("sub_id long, mask long, since timestamp, until timestamp").parquet(at)
    return drained(operations.deliveries(event_stream(spark, sf_dir, files_per_batch), leases, "1 day", DELAY), base=base)


def stream_counts(spark: SparkSession, sf_dir: str, called: Callable[[dict], None] | None = None, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Counters by event type that a running stream reports, without a pass of their own.

    The stream writes its events; what a batch observes on the way is handed to
    ``called`` and kept beside them, so a restart or a batch that is run again
    counts nothing twice.  The sums in the end add a few rows for each batch.
    """
    base = stream_dir(spark, base)

    def write(events: DataFrame, batch: int) -> None:
        seen = Observation()
        metrics.observed_types(events, seen).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        if called:
            called(seen.get)
        metrics.totals(spark, [seen.get]).coalesce(1).write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")

    events = event_stream(spark, sf_dir, files_per_batch).select("event_id", "type", "status")
    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema(f"{metrics.COUNTS}, batch long").parquet(f"{base}/counts") if exists(spark, f"{base}/counts") else spark.createDataFrame([], metrics.COUNTS)
    return counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"))


AT = "struct<batch:bigint,ts:timestamp,event_id:bigint>"
STATE = f"device_id long, slot int, installed boolean, since {AT}, ended {AT}"


def step(installed: set[int], active: int, slot: int, kind: int) -> tuple[int, int]:
    """The active slot (-1: none) and the status after one command; ``installed`` is changed in place."""
    if kind == 1:
        installed.add(slot)
    elif kind == 2:
        if slot not in installed:
            return active, -7
        active = slot
    elif kind == 4:
        if active == slot:
            active = -1
    elif kind == 8:
        if slot not in installed:
            return active, -7
        installed.discard(slot)
        active = -1 if active == slot else active
    return active, 0


def merged(state: DataFrame, events: DataFrame, batch: int) -> DataFrame:
    """The state of each device's slots after the commands of a batch, in order of ``ts, event_id``.

    A slot's state is whether it is installed, its last effective enable
    (``since``) and its last disable or delete (``ended``).  An enable before
    the batch's first install or delete counts if the slot was installed before.
    Windows and aggregates spill; no task holds a device's rows in memory.
    """
    at = F.struct(F.lit(batch).cast("long").alias("batch"), "ts", "event_id")
    before = Window.partitionBy("device_id", "slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("type").isin(INSTALL, DELETE), F.col("type"))
    seen = events.where(F.col("type").isin(INSTALL, ENABLE, DISABLE, DELETE)).withColumn("prior", F.last(turns, ignorenulls=True).over(before))
    enabled = F.col("type") == ENABLE
    fresh = seen.groupBy("device_id", "slot").agg(
        F.max(F.lit(None).cast("boolean")).alias("was"),
        F.max_by(turns, F.when(turns.isNotNull(), at)).alias("turn"),
        F.max(F.when(enabled & F.col("prior").isNull(), at)).alias("open"),
        F.max(F.when(enabled & (F.col("prior") == INSTALL), at)).alias("since"),
        F.max(F.when(F.col("type").isin(DISABLE, DELETE), at)).alias("ended"),
    )
    held = state.select("device_id", "slot", F.col("installed").alias("was"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast(AT).alias("open"), "since", "ended")
    both = held.unionByName(fresh).groupBy("device_id", "slot").agg(*(F.max(c).alias(c) for c in ("was", "turn", "open", "since", "ended")))
    return both.select("device_id", "slot", F.coalesce(F.col("turn") == INSTALL, "was", F.lit(False)).alias("installed"), F.greatest("since", F.when(F.col("was"), F.col("open"))).alias("since"), "ended")


def active_slots(state: DataFrame) -> DataFrame:
    """``device_id, slot`` of the active profiles: the last effective enable of a device, unless it ended since."""
    last = state.where("since is not null").groupBy("device_id").agg(F.max(F.struct("since", "slot", "ended")).alias("x"))
    return last.where("x.ended is null or x.ended < x.since").where("x.slot >= 0").select("device_id", F.col("x.slot").alias("slot"))


def stream_lifecycle(spark: SparkSession, sf_dir: str, base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The active profile of each device at the end of the stream.

    Each batch merges its commands into the table of states that the batch
    before wrote; a batch that is run again writes the same table again.
    """
    base = stream_dir(spark, base)

    def kept() -> list[int]:
        return sorted(int(n) for n in children(spark, f"{base}/state") if n.isdigit() and exists(spark, f"{base}/state/{n}/_SUCCESS"))

    def state(batch: int) -> DataFrame:
        held = [b for b in kept() if b <= batch]
        return spark.read.schema(STATE).parquet(f"{base}/state/{held[-1]}") if held else spark.createDataFrame([], STATE)

    def fold(events: DataFrame, batch: int) -> None:
        merged(state(batch - 1), events, batch).write.mode("overwrite").parquet(f"{base}/state/{batch}")
        for old in kept():  # a batch that is run again needs the one before it
            if old < batch - 1:
                remove(spark, f"{base}/state/{old}")

    query = event_stream(spark, sf_dir, files_per_batch).writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return active_slots(state(max(kept(), default=-1)))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, with a watermark; what the watermark has passed."""
    days = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "type").agg(F.count("*").alias("n"))
    return drained(days.select(F.col("window.start").alias("day"), "type", "n"))
