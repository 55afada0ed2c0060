"""More queries beside their SQL: texts of events, log and tool output, changes of the registry and of subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import events as ev, kpi, lifecycle, logs, registry as reg
from ..schema import EVENT_BITS
from ..sources import files
from ..sources.sinks import bench_document
from ..sources.tables import device_events, registry, table
from .catalog import E, R, _ICCID, _LEVEL_SQL, _TAG_SQL, _stats, _stats_sql, log_records, query

_TEXTS = " ".join(f"WHEN {b} THEN '{t}'" for b, _, t in EVENT_BITS if b not in (256, 512))


@query(
    f"""WITH {E}, d AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN CAST(1 AS BIGINT) << (k % 11) ELSE type END AS bits, CAST(least(100, floor(value)) AS INTEGER) AS pct, event_type FROM e)
 SELECT event_id, CASE bits WHEN 256 THEN 'Download ' || pct || '%' WHEN 512 THEN 'Error: ' || event_type {_TEXTS} ELSE 'Event ' || bits END AS shown FROM d"""
)
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line shown for each event, for bits with and without a text."""
    bits = F.when(F.col("k") % 3 == 0, F.expr("shiftleft(1L, k % 11)")).otherwise(F.col("type"))
    pct = F.least(F.lit(100), F.floor("value")).cast("int")
    return device_events(spark, sf_dir).select("event_id", ev.shown_text(bits, pct, F.col("event_type")).alias("shown"))


@query(
    f"""WITH g AS (SELECT event_id, ts, {_LEVEL_SQL} AS lvl, event_type, user_id FROM events),
 l AS (SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || {_TAG_SQL} || '] [' || event_type || '] device ' || user_id AS line FROM g) SELECT event_id, line FROM l WHERE contains(line, '[ERROR]')"""
)
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines that carry the mark of a failure."""
    return logs.failures(logs.formatted(log_records(spark, sf_dir)), "[ERROR]").select("event_id", "line")


@query("SELECT doc_id, left(text, 63) AS cut, CAST(length(left(text, 63)) AS INTEGER) AS n FROM documents")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = codec.cut_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("cut"), F.length(cut).alias("n"))


@query(
    f"""WITH {E}, a AS (SELECT {_ICCID} AS iccid_hex, event_id, value FROM e WHERE type IN (1, 2))
 SELECT iccid_hex, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM a GROUP BY iccid_hex"""
)
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot by installs, with the rows of enables laid over it: the latest row of each key stays."""
    key = codec.iccid_hex(F.col("device_id"), F.col("slot")).alias("iccid_hex")
    rows = lambda kind: device_events(spark, sf_dir).where(F.col("type") == kind).select(key, "event_id", "value")
    return reg.upsert(rows(1), rows(2), "iccid_hex", "event_id")


@query(
    f"""WITH {E}, {R}, n AS (SELECT {_ICCID} AS iccid_hex, 'line ' || max(k) AS nickname FROM e WHERE type = 4 GROUP BY ALL)
 SELECT r.iccid_hex, state, coalesce(n.nickname, 'Profile ' || slot) AS nickname FROM r LEFT JOIN n USING (iccid_hex)"""
)
def nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the nicknames that were set; the others keep theirs."""
    events = device_events(spark, sf_dir)
    named = registry(events).select("iccid_hex", "state", F.concat(F.lit("Profile "), F.col("slot").cast("string")).alias("nickname"))
    new = events.where("type = 4").groupBy(codec.iccid_hex(F.col("device_id"), F.col("slot")).alias("iccid_hex")).agg(F.concat(F.lit("line "), F.max("k").cast("string")).alias("nickname"))
    return reg.renamed(named, new)


@query(
    f"""WITH {E}, g(event_type) AS (VALUES ('click'), ('error'), ('reboot'), ('view')), st AS ({_stats_sql('event_type', 'value', 'e')})
 SELECT event_type, coalesce(n, 0) AS n, coalesce(mean_us, 0) AS mean_us, coalesce(median_us, 0) AS median_us, coalesce(p99_us, 0) AS p99_us, coalesce(min_us, 0) AS min_us, coalesce(max_us, 0) AS max_us FROM g LEFT JOIN st USING (event_type)"""
)
def latency_of_all_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the wanted groups; one without samples has zeros."""
    groups = spark.createDataFrame([("click",), ("error",), ("reboot",), ("view",)], "event_type string")
    stats = kpi.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    return kpi.with_empty_groups(_stats(stats, "event_type"), groups, ["event_type"])


_RESULTS = "SELECT event_type AS name, round(avg(value), 2) AS mean_us, round(min(value), 2) AS min_us, round(max(value), 2) AS max_us, CAST(count(*) AS INTEGER) AS iterations FROM events GROUP BY event_type"


@query(_RESULTS)
def bench_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results written as JSON between marks in a report, and read back from it."""
    results = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 2).alias("mean_us"), F.min("value").alias("min_us"), F.max("value").alias("max_us"), F.count("*").alias("iterations"))
    report = bench_document(results).select(F.concat(F.lit("warming up\n"), F.col("value"), F.lit("done\n")).alias("value"))
    return files.marked_rows(report).select("name", "mean_us", "min_us", "max_us", "iterations")


@query("SELECT p_partkey, unnest(['text', 'data', 'bss']) AS name, unnest([CAST(p_size AS BIGINT) * 1000, p_size, p_partkey]) AS value FROM part")
def size_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a size tool's output, a header line above a line of numbers, for each part."""
    value = F.format_string("   text\t   data\t bss\tfilename\n%d\t%d\t %d\tlib.so", F.col("p_size") * 1000, F.col("p_size"), F.col("p_partkey"))
    pairs = files.size_columns(table(spark, sf_dir, "part").select("p_partkey", value.alias("value")), ["p_partkey"])
    return pairs.select("p_partkey", "name", "value")


@query("SELECT count_if(p_size % 3 = 0) AS n_symbols FROM part")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined symbols among the lines of a symbol table."""
    kind = F.when(F.col("p_size") % 3 == 0, " T ").otherwise(F.when(F.col("p_size") % 3 == 1, " U ").otherwise(" t "))
    return files.exported_symbols(table(spark, sf_dir, "part").select(F.concat(F.lpad(F.hex("p_partkey"), 16, "0"), kind, F.col("p_name")).alias("value")))


@query("SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'lib' || lower(p_brand) || '.so' ELSE 'linux-vdso.so.1' END AS library FROM part WHERE p_size % 2 = 0 OR p_size % 5 = 0")
def needed_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries in the lines of a loader's list."""
    line = (
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\tlib"), F.lower("p_brand"), F.lit(".so => /lib/x (0x0001)")))
        .when(F.col("p_size") % 5 == 0, "\tlinux-vdso.so.1 (0x0002)")
        .otherwise("\t/lib64/loader.so (0x0003)")
    )
    return files.needed_libraries(table(spark, sf_dir, "part").select(line.alias("value"))).distinct()


@query("SELECT o_orderkey, printf('%,d', CAST(o_totalprice AS BIGINT)) AS shown FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)")
def thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.thousands(F.col("o_totalprice")).alias("shown"))


@query("SELECT event_id, CASE WHEN code IS NULL OR code = '' THEN -1 ELSE 0 END AS status FROM (SELECT event_id, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'LPA:1$host$' || event_id END AS code FROM events)")
def checked_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation codes that can't be used are rejected."""
    code = F.when(F.col("device_id") % 3 == 1, "").when(F.col("device_id") % 3 == 2, F.concat(F.lit("LPA:1$host$"), F.col("event_id").cast("string")))
    return device_events(spark, sf_dir).select("event_id", F.when(codec.missing_activation_code(code), -1).otherwise(0).alias("status"))


# -- deletes, subscriptions over time, ends of operations ---------------------------------------

#: Every fifth report of progress stands for a delete here, so that deletes occur.
D = f"{E}, x AS (SELECT * REPLACE (CASE WHEN type = 256 AND k % 5 = 0 THEN 8 ELSE type END AS type) FROM e)"


def events_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_events(spark, sf_dir).withColumn("type", F.when((F.col("type") == 256) & (F.col("k") % 5 == 0), F.lit(8).cast("long")).otherwise(F.col("type")))


@query(
    f"""WITH {D}, f AS (SELECT *, coalesce(last_value(CASE WHEN type IN (1, 8) THEN type END IGNORE NULLS) OVER (PARTITION BY device_id, slot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS inst FROM x),
 le AS (SELECT device_id, arg_max(slot, row(ts, event_id)) AS slot, max(row(ts, event_id)) AS since FROM f WHERE type = 2 AND inst GROUP BY device_id)
 SELECT device_id, slot FROM le WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.device_id = le.device_id AND f.slot = le.slot AND f.type IN (4, 8) AND row(f.ts, f.event_id) > le.since)"""
)
def active_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active profile of each device where profiles are deleted as well."""
    return lifecycle.active_profiles(events_with_deletes(spark, sf_dir))


@query(f"WITH {D}, t AS (SELECT device_id, slot, arg_max(type, row(ts, event_id)) AS last FROM x WHERE type IN (1, 8) GROUP BY device_id, slot) SELECT device_id, count_if(last = 1) AS n_installed, count_if(last = 8) AS n_deleted FROM t GROUP BY device_id")
def installed_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many profiles of a device are installed and deleted in the end."""
    turns = events_with_deletes(spark, sf_dir).where(F.col("type").isin(lifecycle.INSTALL, lifecycle.DELETE))
    last = turns.groupBy("device_id", "slot").agg(F.max_by("type", F.struct("ts", "event_id")).alias("last"))
    return last.groupBy("device_id").agg(F.count_if(F.col("last") == lifecycle.INSTALL).alias("n_installed"), F.count_if(F.col("last") == lifecycle.DELETE).alias("n_deleted"))


_CHANGING = [(1, 7, "2024-01-01", "2024-01-10"), (2, 512, "2024-01-05", None), (3, 775, "2024-01-12", "2024-01-20"), (1, 256, "2024-01-10", "2024-01-15")]


@query(
    f"WITH {E}, s(sub_id, mask, since, until) AS (VALUES "
    + ", ".join(f"(CAST({i} AS BIGINT), CAST({m} AS BIGINT), TIMESTAMP '{a}', " + (f"TIMESTAMP '{b}')" if b else "NULL)") for i, m, a, b in _CHANGING)
    + ") SELECT event_id, sub_id FROM e JOIN s ON (type & mask) <> 0 AND ts >= since AND (until IS NULL OR ts < until)"
)
def changing_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to subscriptions that begin and end over time."""
    subs = spark.createDataFrame(_CHANGING, "sub_id long, mask long, since string, until string")
    subs = subs.withColumn("since", F.col("since").cast("timestamp_ntz")).withColumn("until", F.col("until").cast("timestamp_ntz"))
    return ev.fanout_while_subscribed(device_events(spark, sf_dir).select("event_id", "ts", "type"), subs).select("event_id", "sub_id")


@query(
    f"""WITH {E}, t AS (SELECT device_id, slot, event_id, type, epoch_us(ts) AS us FROM e WHERE type IN (1, 2, 512)),
 p AS (SELECT *, lag(type) OVER w AS before, lag(us) OVER w AS before_us FROM t WINDOW w AS (PARTITION BY device_id, slot ORDER BY us, event_id))
 SELECT device_id, slot, event_id, coalesce(before = 1 AND us - before_us <= 86400000000, false) AS counted FROM p WHERE type <> 1"""
)
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of installs; late and repeated ones are ignored."""
    return lifecycle.completions(device_events(spark, sf_dir), 1, [2, 512], 86_400_000_000)
