"""Latency statistics, threshold verdicts and coverage roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of an approximate percentile are off by at most one over this.
ACCURACY = 10_000


#: Groups up to which their statistics are broadcast to the samples.
FEW_GROUPS = 10_000


def _broadcast_if_few(stats: DataFrame) -> DataFrame:
    """``stats``, broadcast if it has few rows; else as it is, so that Spark joins by a shuffle."""
    rows = stats.limit(FEW_GROUPS + 1).collect()
    return F.broadcast(stats.sparkSession.createDataFrame(rows, stats.schema)) if len(rows) <= FEW_GROUPS else stats


def order_statistics(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n, mean, median, p99, min, max`` of each group, exactly.

    The 99th percentile is the nearest rank: the value at index
    ``min(floor(n * 0.99), n - 1)`` of the sorted values.  Sorting a group in one
    task doesn't hold for large groups, so approximate percentiles bracket the
    ranks first: a partial count tells how many values lie below the brackets,
    and only the distinct values inside them are ranked.
    """
    kept = samples.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    slack = 2.0 / ACCURACY
    ends = [max(0.0, 0.5 - slack), 0.5 + slack, 0.99 - slack, min(1.0, 0.99 + slack)]
    n = F.col("n")
    stats = kept.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("__v").alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"),
        F.percentile_approx("__v", ends, ACCURACY).alias("__q"),
    )
    stats = _broadcast_if_few(stats)
    bracket = lambda which: F.struct(F.lit(which).alias("which"), F.col("__q")[2 * which].alias("lo"), F.col("__q")[2 * which + 1].alias("hi"))
    near = kept.join(stats.select(*by, F.array(bracket(0), bracket(1)).alias("__b")), by)
    below = near.groupBy(*by).agg(*(F.count_if(F.col("__v") < F.col("__b")[i]["lo"]).alias(f"__below{i}") for i in range(2)))
    inside = near.select(*by, "__v", F.explode(F.transform(F.filter("__b", lambda b: (F.col("__v") >= b["lo"]) & (F.col("__v") <= b["hi"])), lambda b: b["which"])).alias("which"))
    counted = inside.groupBy(*by, "which", "__v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "which").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = [(0, F.floor((n - 1) / 2)), (0, F.floor(n / 2)), (1, F.least(F.floor(n * F.lit(0.99)), n - 1))]
    placed = counted.withColumn("upto", upto).join(stats.select(*by, "n").join(below, by), by)
    at = lambda which, rank: F.min(F.when((F.col("which") == which) & (F.col(f"__below{which}") + F.col("upto") > rank), F.col("__v")))
    wide = placed.groupBy(*by).agg(*(at(which, rank).alias(f"__x{i}") for i, (which, rank) in enumerate(ranks)))
    return stats.join(wide, by).select(*by, "n", "mean", ((F.col("__x0") + F.col("__x1")) / 2).alias("median"), F.col("__x2").alias("p99"), "min", "max")


def with_empty_groups(stats: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of all ``groups(by)``: those without samples have zeros."""
    values = [c for c in stats.columns if c not in by]
    return groups.select(*by).distinct().join(stats, by, "left").select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def verdicts(stats: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Measured groups that have a target: PASS if the median keeps to it, else OVER."""
    return stats.join(targets, key).withColumn("verdict", F.when(F.col("median") <= F.col("target"), "PASS").otherwise("OVER"))


def coverage(rows: DataFrame, category: str, verified: str) -> DataFrame:
    """Total, verified and percentage of each category and of all, with PASS where all are verified."""
    rolled = rows.rollup(category).agg(F.count("*").alias("total"), F.count_if(F.col(verified)).alias("verified"), F.grouping(category).alias("__all"))
    return rolled.select(
        F.when(F.col("__all") == 1, "TOTAL").otherwise(F.coalesce(category, F.lit("none"))).alias("category"),
        "total",
        "verified",
        F.floor(F.col("verified") * 100 / F.col("total")).cast("long").alias("pct"),
        F.when(F.col("verified") == F.col("total"), "PASS").otherwise("WARN").alias("verdict"),
    )


def cross_references(xref: DataFrame) -> DataFrame:
    """``suite, test, req_id`` of ``suite, tests: array<struct<name, reqs>>``."""
    tests = xref.select("suite", F.explode("tests").alias("t"))
    return tests.select("suite", F.col("t.name").alias("test"), F.explode("t.reqs").alias("req_id"))


def all_true(checks: DataFrame, by: list[str], name: str, ok: str) -> DataFrame:
    """Whether all checks of a group hold, and the names of those that don't, in order.

    Failed names are made distinct before they are gathered, so a group's list
    is as long as its vocabulary of checks.
    """
    failed = checks.where(~F.col(ok)).select(*by, name).distinct().groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(name)), ";").alias("failed"))
    groups = checks.groupBy(*by).agg(F.bool_and(ok).alias("passed"), F.count("*").alias("n"))
    return groups.join(failed, by, "left").withColumn("failed", F.coalesce("failed", F.lit("")))


def bench(name: str, iterations: int, work, warm_up: int = 3) -> list[tuple[str, int, float]]:
    """Samples ``(name, iter, us)`` of calls of ``work``, after some calls that don't count."""
    import time

    for _ in range(warm_up):
        work()
    out = []
    for i in range(iterations):
        start = time.perf_counter_ns()
        work()
        out.append((name, i, float((time.perf_counter_ns() - start) // 1000)))
    return out


def size_totals(sizes: DataFrame, by: list[str]) -> DataFrame:
    """``rom, ram, total`` of ``by, name, value`` pairs of a size tool: code and constants, variables, and all; whole bytes, 0 for none."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("value"))), F.lit(0)).cast("long")
    return sizes.groupBy(*by).agg(of("text", "data").alias("rom"), of("data", "bss").alias("ram"), of("text", "data", "bss").alias("total"))
