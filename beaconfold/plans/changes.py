"""Queries on operations in flight, subscriptions, protocol and registry over time, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import protocol, temporal
from ..operators.events import CONSENT_MESSAGE
from ..sources.tables import device_events, registry, table
from .catalog import E, R, event_counts, profile_lookup, query  # noqa: F401
from .reports import _CHANGING, D, events_with_deletes

#: Microseconds up to which a stream of all events has settled: an hour before the last event, in whole milliseconds.
_SETTLED = "(epoch_us(max(ts)) // 1000 - 3600000) * 1000"


@query(
    f"""WITH {E}, w AS (SELECT {_SETTLED} AS us FROM e WHERE type IN (1, 2, 512)), x AS (SELECT device_id, slot, event_id, type, epoch_us(ts) AS us FROM e WHERE type IN (1, 2, 512) AND epoch_us(ts) <= (SELECT us FROM w)),
 g AS (SELECT *, first_value(CASE WHEN type <> 1 THEN us END IGNORE NULLS) OVER (PARTITION BY device_id, slot ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us AS took FROM x),
 s AS (SELECT device_id, slot, event_id, CASE WHEN took <= 86400000000 THEN took END AS took_us, took IS NOT NULL OR us + 86400000000 < (SELECT us FROM w) AS settled FROM g WHERE type = 1)
 SELECT device_id, slot, event_id, took_us, CASE WHEN took_us IS NULL THEN -11 ELSE 0 END AS status FROM s WHERE settled"""
)
def stream_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs of a stream that ended or timed out, by keyed state and event-time timers."""
    from ..streaming.queries import stream_operations as run

    return run(spark, sf_dir)


@query(f"WITH {E} SELECT device_id, slot, event_id FROM e WHERE type IN (2, 512)")
def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of operations, each once, from a stream that delivers every event twice."""
    from ..streaming.queries import stream_ends as run

    return run(spark, sf_dir)


@query(f"WITH {E} SELECT device_id, slot, event_id, true AS granted, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [INFO ] [listener] {CONSENT_MESSAGE}' AS line FROM e WHERE type = 1 AND k % 2 = 1")
def stream_consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consents to the prompts that require one, each once, from a stream that delivers every prompt twice."""
    from ..streaming.queries import stream_consents as run

    return run(spark, sf_dir)


@query(
    f"WITH {E}, s(sub_id, mask, since, until) AS (VALUES "
    + ", ".join(f"(CAST({i} AS BIGINT), CAST({m} AS BIGINT), TIMESTAMP '{a}', TIMESTAMP '{b or '2024-03-01'}')" for i, m, a, b in _CHANGING)
    + ") SELECT event_id, sub_id FROM e JOIN s ON (type & mask) <> 0 AND ts >= since AND ts < until"
)
def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a stream of events to a stream of subscriptions that begin and end."""
    from ..streaming.queries import stream_subscriptions as run

    subs = spark.createDataFrame(_CHANGING, "sub_id long, mask long, since string, until string")
    return run(spark, sf_dir, subs.withColumn("since", F.to_timestamp("since")).withColumn("until", F.to_timestamp("until")), "2024-03-01")


_COUNTS = f"WITH {E} SELECT type, count(*) AS n, CAST(count_if(status < 0) AS BIGINT) AS n_errors FROM e GROUP BY type"


@query(_COUNTS)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by type that a stream reports while it writes its events."""
    from ..streaming.queries import stream_counts as run

    return run(spark, sf_dir)


@query(_COUNTS)
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a batch query: observed while the registry is computed, without a second pass over the events."""
    from pyspark.sql import Observation

    from ..streaming.metrics import observed_types, totals

    seen = Observation()
    registry(observed_types(device_events(spark, sf_dir), seen)).write.format("noop").mode("overwrite").save()
    return totals(spark, [seen.get])


def _step_sql() -> str:
    cases = " ".join(f"WHEN t.state = {s} AND x.type = {k} THEN {to}" for (s, k), to in protocol.STEPS.items())
    return f"CASE {cases} ELSE -1 END"


_KINDS = ", ".join(str(k) for k in sorted({k for _, k in protocol.STEPS}))


@query(
    f"""WITH RECURSIVE {D}, o AS MATERIALIZED (SELECT device_id, slot, event_id, type, row_number() OVER (PARTITION BY device_id, slot ORDER BY ts, event_id) AS n FROM x WHERE type IN ({_KINDS})),
 t AS (SELECT DISTINCT device_id, slot, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(NULL AS BIGINT) AS broken FROM o
 UNION ALL SELECT t.device_id, t.slot, x.n, CASE WHEN ({_step_sql()}) < 0 THEN t.state ELSE ({_step_sql()}) END, CASE WHEN ({_step_sql()}) < 0 THEN x.event_id END
 FROM t JOIN o x ON x.device_id = t.device_id AND x.slot = t.slot AND x.n = t.n + 1 WHERE t.broken IS NULL),
 z AS (SELECT device_id, slot, arg_max(state, n) AS state, arg_max(broken, n) FILTER (WHERE broken IS NOT NULL) AS broken FROM t GROUP BY device_id, slot)
 SELECT z.device_id, z.slot, c.n_steps, z.state AS end_state, z.broken AS broken_event_id FROM z JOIN (SELECT device_id, slot, count(*) AS n_steps FROM o GROUP BY ALL) c USING (device_id, slot)"""
)
def protocol_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each profile that breaks the lifecycle's protocol."""
    return protocol.first_broken_steps(events_with_deletes(spark, sf_dir))


_VALID = f"""{D}, c AS (SELECT *, lag(type) OVER (PARTITION BY device_id, slot ORDER BY ts, event_id) AS prior FROM x WHERE type IN (1, 8)),
 k AS (SELECT *, lead(ts) OVER (PARTITION BY device_id, slot ORDER BY ts, event_id) AS nxt FROM c WHERE CASE WHEN prior IS NULL THEN type = 1 ELSE prior <> type END),
 v AS (SELECT device_id, slot, ts AS valid_from, nxt AS valid_to FROM k WHERE type = 1)"""


@query(f"WITH {_VALID} SELECT device_id, slot, valid_from, valid_to FROM v")
def registry_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each profile was in the registry."""
    return temporal.validity(events_with_deletes(spark, sf_dir))


_CUTS = ("2024-01-10", "2024-01-20")


@query(
    f"""WITH {_VALID}, a AS (SELECT device_id, slot FROM v WHERE valid_from <= TIMESTAMP '{_CUTS[0]}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_CUTS[0]}')),
 b AS (SELECT device_id, slot FROM v WHERE valid_from <= TIMESTAMP '{_CUTS[1]}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_CUTS[1]}'))
 SELECT device_id, slot, 1 AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT device_id, slot, -1 FROM (FROM a EXCEPT FROM b)"""
)
def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that came and went between two instants."""
    first, second = (F.lit(c).cast("timestamp_ntz") for c in _CUTS)
    return temporal.changes_between(temporal.validity(events_with_deletes(spark, sf_dir)), first, second)


@query(
    f"""WITH {D} SELECT event_id, device_id, slot, coalesce(last_value(CASE WHEN type IN (1, 8) THEN type END IGNORE NULLS) OVER
 (PARTITION BY device_id, slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS installed_at FROM x"""
)
def installed_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the profile of each event was in the registry when it happened: a temporal join with the commands."""
    events = events_with_deletes(spark, sf_dir)
    return temporal.installed_when(events.select("event_id", "device_id", "slot", "ts"), events).select("event_id", "device_id", "slot", "installed_at")


@query(f"WITH {E}, {R}, q AS (SELECT event_id, '8901' || lpad(upper(to_hex(device_id)), 8, '0') || lpad(upper(to_hex(CAST(k % 16 AS BIGINT))), 8, '0') AS iccid_hex FROM e) SELECT event_id, q.iccid_hex, CASE WHEN r.state IS NULL THEN -7 ELSE 0 END AS status, r.state FROM q LEFT JOIN r USING (iccid_hex)")
def bucketed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of every event's key in a registry that is stored in buckets of the key, as the questions are: no shuffle."""
    from ..functions.codec import iccid_hex
    from ..sources.buckets import bucketed

    events = device_events(spark, sf_dir)
    asked = events.select("event_id", iccid_hex(F.col("device_id"), F.col("k") % 16).alias("iccid_hex"))
    held = registry(events).select("iccid_hex", "state")
    own, questions = bucketed(held, "iccid_hex", "registry"), bucketed(asked, "iccid_hex", "lookups")
    found = questions.hint("merge").join(own, "iccid_hex", "left")
    return found.select("event_id", "iccid_hex", F.when(F.col("state").isNull(), -7).otherwise(0).alias("status"), "state")


_PROPS = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"k": "many"}' WHEN 3 THEN '{"other": 1}' WHEN 4 THEN '{"k": [' || event_id || ']}' ELSE 'no json' END"""


@query(
    f"""WITH p AS (SELECT event_id, {_PROPS} AS raw FROM events)
 SELECT event_id, coalesce(CASE WHEN json_valid(raw) AND json_type(raw, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(raw, '$.k') AS INTEGER) END, 30) AS k,
 CASE WHEN NOT json_valid(raw) THEN 'broken' WHEN json_type(raw, '$.k') IS NULL THEN 'missing' WHEN json_type(raw, '$.k') = 'NULL' THEN 'null'
 WHEN json_type(raw, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'given' ELSE 'other type' END AS origin FROM p"""
)
def typed_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of a JSON object with its default for what is missing, null, of another type or no JSON, through VARIANT."""
    from ..sources.files import field_or_default, field_origin

    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_PROPS).alias("raw")).withColumn("v", F.expr("try_parse_json(raw)"))
    return rows.select("event_id", field_or_default("v", "k", "int", 30).alias("k"), field_origin("v", "k", "int").alias("origin"))
