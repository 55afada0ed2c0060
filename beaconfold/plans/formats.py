"""Queries on arguments, names, defaults, keys and sizes, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import kpi, registry as reg
from ..operators.conformance import differences
from ..schema import BAUD_RATES, STATUS
from ..sources import files
from ..sources.tables import device_events, table
from .catalog import E, query

_CALL = [name for name, _, _ in codec.CALLS] + ["no such call"]
_CALL_SQL = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_CALL))
_NEEDS = " ".join(
    f"WHEN '{n}' THEN " + " AND ".join(filter(None, ["TRUE", needs and "handle", needs == "ready" and "ready", wanted and "argument", wanted == "buffer" and "coalesce(length >= 2, FALSE)"]))
    for n, needs, wanted in codec.CALLS
)


@query(
    f"""WITH {E}, c AS (SELECT event_id, CASE event_id % {len(_CALL)} {_CALL_SQL} END AS call, device_id % 7 <> 0 AS handle, device_id % 5 <> 0 AS ready, slot <> 3 AS argument, CASE WHEN k % 4 <> 0 THEN k % 4 END AS length FROM e)
 SELECT event_id, call, CASE WHEN CASE call {_NEEDS} ELSE FALSE END THEN 0 ELSE -1 END AS status FROM c"""
)
def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every kind of call by its handle and arguments, before anything is done."""
    call = F.element_at(F.array(*map(F.lit, _CALL)), (F.col("event_id") % len(_CALL) + 1).cast("int"))
    length = F.when(F.col("k") % 4 != 0, F.col("k") % 4)
    status = codec.argument_status(call, F.col("device_id") % 7 != 0, F.col("device_id") % 5 != 0, F.col("slot") != 3, length)
    return device_events(spark, sf_dir).select("event_id", call.alias("call"), status.alias("status"))


_BACKEND = [("signup", "SUCCESS"), ("purchase", "FAILED"), ("click", "INVALID"), ("view", "NOT_SUPPORTED"), ("error", "OTHER")]


@query(
    f"""WITH {E}, n(i, name, code) AS (VALUES {", ".join(f"({i}, '{n}', {c})" for i, (c, n, _) in enumerate(STATUS))})
 SELECT event_id, name, CAST(code AS INTEGER) AS code, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN -1 WHEN 'view' THEN -13 ELSE -14 END AS backend FROM e JOIN n ON i = k % {len(STATUS)}"""
)
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of status names, and the library's status for a backend's result."""
    name = F.element_at(F.array(*(F.lit(n) for _, n, _ in STATUS)), F.col("k") % len(STATUS) + 1)
    result = F.create_map(*(F.lit(x) for pair in _BACKEND for x in pair))[F.col("event_type")]
    return device_events(spark, sf_dir).select("event_id", name.alias("name"), codec.required_status_code(name).alias("code"), codec.backend_status(result).alias("backend"))


@query(
    f"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 30000 ELSE p_size % 3 * 100 END AS timeout_ms, CASE WHEN p_size % 4 = 0 THEN 3 ELSE p_size % 4 END AS retries,
 CASE WHEN p_size * 2400 IN ({", ".join(map(str, BAUD_RATES))}) THEN p_size * 2400 ELSE 115200 END AS baud,
 CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS level, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'N/A' END AS tool FROM part"""
)
def config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration with defaults for what is 0 or not given, line speeds, levels and output of tools."""
    size = F.col("p_size")
    level = F.when(size % 3 == 0, "SIMPLE").when(size % 3 == 1, "DETAIL").otherwise("QUIET")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        codec.or_default(F.when(size % 3 != 0, size % 3 * 100), 30_000).alias("timeout_ms"),
        codec.or_default(size % 4, 3).alias("retries"),
        codec.line_speed(size * 2400).alias("baud"),
        codec.user_level(level).alias("level"),
        codec.or_unknown(F.when(size % 2 == 0, F.col("p_brand"))).alias("tool"),
    )


@query(
    """SELECT c_custkey, upper(left(rpad(lpad(to_hex(CAST(c_custkey AS BIGINT) * 40503), 32, 'A'), 20, '0'), 20)) AS cut_key, '8901' || lpad(upper(to_hex(CAST(c_custkey AS BIGINT))), 16, '0') AS counted,
 '0x' || lower(to_hex(CAST(c_custkey AS BIGINT))) AS shown, regexp_replace(c_name || '-' || c_mktsegment, '[^A-Za-z0-9]', '_', 'g') AS safe, '#' || lpad(upper(to_hex(CAST(c_custkey * 4099 % 16777216 AS BIGINT))), 6, '0') AS colour,
 (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) | (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END) AS self_test FROM customer"""
)
def key_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cut from long literals, keys of running numbers, hexadecimal, names, colours and self-test bits."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        codec.to_hex(codec.from_hex(F.lpad(F.hex(key.cast("long") * 40503), 32, "A"), 10)).alias("cut_key"),
        codec.counted_iccid(key).alias("counted"),
        codec.lower_hex(key).alias("shown"),
        codec.safe_name(F.concat_ws("-", "c_name", "c_mktsegment")).alias("safe"),
        codec.colour(key * 4099 % 16777216).alias("colour"),
        codec.self_test(key % 2 == 0, key % 3 == 0).alias("self_test"),
    )


@query(
    """SELECT p_brand, CAST(sum(p_size * 1000 + p_size) AS BIGINT) AS rom, CAST(sum(p_size + p_partkey) AS BIGINT) AS ram, CAST(sum(p_size * 1000 + p_size + p_partkey) AS BIGINT) AS total,
 CAST(sum(p_size * 1000 + p_size) // 1024 AS BIGINT) AS rom_kb FROM part GROUP BY p_brand"""
)
def size_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of sizes by brand, from a size tool's output for each part."""
    value = F.format_string("   text\t   data\t bss\tfilename\n%d\t%d\t %d\tlib.so", F.col("p_size") * 1000, F.col("p_size"), F.col("p_partkey"))
    pairs = files.size_columns(table(spark, sf_dir, "part").select("p_brand", value.alias("value")), ["p_brand"])
    return kpi.size_totals(pairs, ["p_brand"]).withColumn("rom_kb", codec.kilobytes(F.col("rom")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first returned line of each order."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    return reg.first_per_key(lines, "l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH {E}, x AS (SELECT DISTINCT event_type AS suite, CAST(k % 10 AS VARCHAR) AS test, 'R-' || slot AS req_id FROM e)
 SELECT req_id, count(*) AS n_tests, string_agg(suite || '/' || test, ',' ORDER BY suite, test) AS tests FROM x GROUP BY req_id"""
)
def requirement_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with the tests that cover them, from suites that nest tests and these requirements.

    Suites, tests and requirements are vocabularies of the events (types, ten
    tests, slots), so nested lists stay short however many events there are.
    """
    seen = device_events(spark, sf_dir).select(F.col("event_type").alias("suite"), (F.col("k") % 10).cast("string").alias("name"), F.concat(F.lit("R-"), F.col("slot").cast("string")).alias("req")).distinct()
    tests = seen.groupBy("suite", "name").agg(F.array_sort(F.collect_list("req")).alias("reqs"))
    suites = tests.groupBy("suite").agg(F.array_sort(F.collect_list(F.struct("name", "reqs"))).alias("tests"))
    flat = kpi.cross_references(suites)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("suite", "test"))), lambda x: F.concat(x["suite"], F.lit("/"), x["test"]))
    return flat.groupBy("req_id").agg(F.count("*").alias("n_tests"), F.array_join(listed, ",").alias("tests"))


_FIELDS = "count_if(type = 1) AS installs, coalesce(bool_or(type = 512), FALSE) AS failures, max(status) AS worst"


@query(
    f"""WITH {E}, a AS (SELECT device_id, slot, {_FIELDS} FROM e WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL), b AS (SELECT device_id, slot, {_FIELDS} FROM e WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL),
 j AS (SELECT device_id, slot, CASE WHEN b.installs IS NULL THEN 'missing' WHEN a.installs IS NULL THEN 'unexpected' ELSE concat_ws(',', CASE WHEN a.installs IS DISTINCT FROM b.installs THEN 'installs' END,
 CASE WHEN a.failures IS DISTINCT FROM b.failures THEN 'failures' END, CASE WHEN a.worst IS DISTINCT FROM b.worst THEN 'worst' END) END AS failed FROM a FULL JOIN b USING (device_id, slot))
 SELECT device_id, slot, failed, failed = '' AS passed FROM j"""
)
def profile_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's later conduct against what its earlier conduct lets one expect, field by field."""
    events, early = device_events(spark, sf_dir), F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    fields = [
        F.count_if(F.col("type") == 1).alias("installs"),
        F.coalesce(F.bool_or(F.col("type") == 512), F.lit(False)).alias("failures"),
        F.max("status").alias("worst"),
    ]
    before, after = (events.where(w).groupBy("device_id", "slot").agg(*fields) for w in (early, ~early))
    return differences(before, after, ["device_id", "slot"], ["installs", "failures", "worst"])
