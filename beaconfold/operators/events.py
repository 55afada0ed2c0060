"""Operators on event rows: routing to subscribers, classification, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import log_line
from ..schema import EVENT_BITS
from .scan import last_before, running_sum


def matches(mask: Column, bits: Column) -> Column:
    return mask.bitwiseAND(bits) != 0


def fanout(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Every event for every subscription whose mask has its bit, by a nested loop over a short list."""
    return events.join(subs, matches(subs["mask"], events["type"]))


def fanout_by_bits(events: DataFrame, subs: DataFrame) -> DataFrame:
    """The same by an equi join: masks are exploded into their bits (event types are single bits)."""
    bits = subs.withColumn("bit", F.explode(F.expr("filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), x -> (x & mask) <> 0)")))
    return events.join(bits, events["type"] == bits["bit"]).drop("bit")


def fanout_while_subscribed(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Every event for each subscription that has its bit and is held when it happens.

    ``subs(sub_id, mask, since, until)`` changes over time; ``until`` is null while
    a subscription lasts.  Masks are exploded into bits, so this is an equi join
    that a stream of events can take part in as well.
    """
    held = (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return fanout_by_bits(events, subs).where(held)


def unsubscribe_status(subs: DataFrame, sub_ids: DataFrame) -> DataFrame:
    """0 for a known subscription, -1 for an unknown one."""
    known = subs.select("sub_id").withColumn("__known", F.lit(1))
    return sub_ids.join(known, "sub_id", "left").select("sub_id", F.when(F.col("__known").isNull(), -1).otherwise(0).alias("status"))


def classified_downloads(rows: DataFrame, progress: str = "progress_pct", state: str = "state_name") -> DataFrame:
    """Event, status and completion of download reports by progress and state."""
    pct, done = F.col(progress), F.col(state) == "DOWNLOADED"
    return rows.select(
        "*",
        F.when(pct < 100, 256).when(done, 1).otherwise(512).cast("long").alias("type"),
        F.when(pct < 100, 1).when(done, 0).otherwise(-14).alias("status"),
        ((pct == 100) | (F.col(state) != "DOWNLOADING")).alias("complete"),
    )


#: Fixed value: what is logged with a consent.
CONSENT_MESSAGE = "User consent required — auto-providing consent"


def consents(prompts: DataFrame) -> DataFrame:
    """A granted consent for each prompt that requires one, with the line that is logged.

    Prompts with a false or null ``consent_required`` get no row.  There is no
    state, so batches and streams alike may pass through.
    """
    line = log_line(F.col("ts"), F.lit(3), F.lit("listener"), F.lit(CONSENT_MESSAGE), False)
    return prompts.where("consent_required").select("device_id", "slot", "event_id", F.lit(True).alias("granted"), line.alias("line"))


def shown_text(bits: Column, progress: Column, detail: Column) -> Column:
    """The line shown for an event."""
    out = F.when(bits == 256, F.format_string("Download %d%%", progress)).when(bits == 512, F.concat(F.lit("Error: "), detail))
    for bit, _, text in EVENT_BITS:
        if bit not in (256, 512):
            out = out.when(bits == bit, F.lit(text))
    return out.otherwise(F.concat(F.lit("Event "), bits.cast("string")))


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") < 0).alias("n_errors"))


def running(events: DataFrame, condition: Column, name: str, *by: str) -> DataFrame:
    """A running count of ``condition`` in each device's order."""
    return running_sum(events, F.when(condition, 1).otherwise(0), name, by)


def with_previous(events: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    return last_before(events, F.struct(column), name, by).withColumn(name, F.col(name)[column])


def with_following(events: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    return last_before(events, F.struct(column), name, by, backwards=True).withColumn(name, F.col(name)[column])
