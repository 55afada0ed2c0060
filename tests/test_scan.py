"""Scans in segments against plain windows, the protocol's automaton against a loop, the registry over time."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from beaconfold.operators import events as ev, extensions, lifecycle, protocol, scan, temporal
from beaconfold.plans import changes

SF = "/root/testdata/sf0.001"
SCHEMA = "device_id long, event_id long, ts timestamp, slot int, type long, value double"


def hot_events(spark, n=900, seed=1):
    """A third of the events on one device, some without a device, some at one instant."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        device = 1 if rnd.random() < 0.34 else rnd.choice([None, *range(2, 12)])
        rows.append((device, i, 1_700_000_000 + (i // 3) * 60 + (0 if i % 50 else -7), rnd.randint(0, 2), rnd.choice([1, 2, 4, 8, 256, 512]), rnd.choice([None, 1.0, 2.0])))
    df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long"))
    return df.withColumn("ts", F.timestamp_seconds("ts")).repartition(5)


CASES = {
    "running": lambda e: ev.running(e, F.col("type") == 1, "x", "device_id"),
    "previous": lambda e: ev.with_previous(e, "value", "x", "device_id"),
    "following": lambda e: ev.with_following(e, "value", "x", "device_id"),
    "installed": lambda e: lifecycle.with_installed(e),
    "timed_out": lambda e: lifecycle.timed_out(e, 1, [2, 512], 600_000_000),
    "completions": lambda e: lifecycle.completions(e, 1, [2, 512], 600_000_000),
    "active": lambda e: lifecycle.active_profiles(e),
    "sessions": lambda e: extensions.sessions(e, "device_id", "ts", 200_000_000),
    "as_of": lambda e: extensions.as_of_join(e.where("type = 512").select("device_id", "event_id", "ts"), e.where("type = 2").dropDuplicates(["device_id", "ts"]).select("device_id", "ts", "value"), ["device_id"], "ts", ["value"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_segments_give_the_rows_of_plain_windows(spark, monkeypatch, name):
    events = hot_events(spark)
    want = sorted(map(str, CASES[name](events).collect()))
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 60)
    assert len(scan.time_cuts(events, "ts")) >= 10
    assert sorted(map(str, CASES[name](events).collect())) == want


def test_no_segment_has_a_hot_device_whole(spark):
    events = hot_events(spark, 3000)
    cuts = scan.time_cuts(events, "ts", 200)
    sizes = events.groupBy("device_id", scan.cuts_up_to(cuts, F.unix_micros("ts")).alias("s")).count()
    hot = events.where("device_id = 1").count()
    assert hot > 900 and sizes.agg(F.max("count")).first()[0] < 200


def test_the_rows_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ev.running(hot_events(spark), F.col("type") == 1, "x", "device_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows by key and segment; counts by key and segment, by key, and by key and segment again for the join.
    assert plan.count("Exchange hashpartitioning") <= 4


def broken_step(rows):
    state = protocol.ABSENT
    for _, event_id, kind in sorted(rows):
        to = protocol.STEPS.get((state, kind))
        if to is None:
            return state, event_id
        state = to
    return state, None


@pytest.mark.parametrize("segment_rows", [None, 40])
def test_composed_tables_equal_a_loop(spark, segment_rows):
    events = hot_events(spark, 800, 4)
    # Mostly legal sequences: the next legal event of a slot, with a few that aren't.
    rnd, states, rows = random.Random(5), {}, []
    for i, r in enumerate(sorted(events.collect(), key=lambda r: (r.ts, r.event_id))):
        key = (r.device_id, r.slot)
        s = states.get(key, protocol.ABSENT)
        kind = rnd.choice([k for (a, k) in protocol.STEPS if a == s]) if rnd.random() < 0.97 else 8
        states[key] = protocol.STEPS.get((s, kind), s)
        rows.append((r.device_id, r.event_id, r.ts, r.slot, kind, r.value))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    groups = {}
    for d, e, t, s, k, _ in rows:
        groups.setdefault((d, s), []).append((t, e, k))
    want = {key: (len(x), *broken_step(x)) for key, x in groups.items()}
    got = {(r.device_id, r.slot): (r.n_steps, r.end_state, r.broken_event_id) for r in protocol.first_broken_steps(df, segment_rows=segment_rows).collect()}
    assert got == want
    assert {x[2] is None for x in want.values()} == {True, False}
    if segment_rows:
        assert protocol.stretches(df, ("device_id", "slot"), segment_rows).agg(F.max("n")).first()[0] <= 45


def test_snapshots_differ_by_what_came_and_went(spark):
    events = hot_events(spark, 600, 8)
    intervals = temporal.validity(events).cache()
    rows = sorted(events.collect(), key=lambda r: (r.ts, r.event_id))
    instants = [rows[i].ts for i in (100, 350, 599)]

    def installed(at):
        held = set()
        for r in rows:
            if r.ts <= at and r.type in (1, 8):
                (held.add if r.type == 1 else held.discard)((r.device_id, r.slot))
        return held

    key = lambda t: F.lit(t)
    for a, b in zip(instants, instants[1:]):
        assert {tuple(r) for r in temporal.snapshot(intervals, key(b)).collect()} == installed(b)
        got = {(r.device_id, r.slot, r.change) for r in temporal.changes_between(intervals, key(a), key(b)).collect()}
        assert got == {(*k, 1) for k in installed(b) - installed(a)} | {(*k, -1) for k in installed(a) - installed(b)}
    intervals.unpersist()


def test_bucketed_lookups_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = changes.bucketed_lookup(spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(str, df.collect())) and df.count() == entry.queries()["event_bits"](spark, SF).count()


@pytest.mark.parametrize("segment_rows", [None, 60])
def test_a_command_does_not_see_itself_however_rows_arrive(spark, monkeypatch, segment_rows):
    """On a cluster a shuffle hands over blocks in any order, so a command may arrive before the event that it is."""
    rows = sorted(hot_events(spark, 600, 9).collect(), key=lambda r: (r.ts, r.event_id))
    want, held = {}, set()
    for r in rows:
        key = (r.device_id, r.slot)
        want[r.event_id] = key in held
        if r.type in (1, 8):
            (held.add if r.type == 1 else held.discard)(key)
    events = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    if segment_rows:
        monkeypatch.setattr(scan, "SEGMENT_ROWS", segment_rows)
    for first in (F.col("turn").isNull(), F.col("turn").isNotNull()):
        monkeypatch.setattr(temporal, "last_before", lambda rows, *a, **k: scan.last_before(rows.coalesce(1).sortWithinPartitions(first), *a, **k))
        got = temporal.installed_when(events.select("event_id", "device_id", "slot", "ts"), events)
        assert {r.event_id: r.installed_at for r in got.collect()} == want


def interval_sides(spark, n, spread=300):
    """Points and intervals with nulls, bounds that meet points, empty and reversed intervals, keys with several."""
    rnd = random.Random(n)
    points = [(i, rnd.choice([None, -100, 0, 100, *(rnd.randint(-spread, spread) for _ in range(9))])) for i in range(n)]
    bands = []
    for i in range(n // 2):
        low = rnd.choice([None, -100, 0, 100, *(rnd.randint(-spread, spread) for _ in range(9))])
        bands.append((rnd.choice([None, i, i // 3]), low, None if low is None else low + rnd.choice([-250, 0, 1, 100, 100, 170, 420])))
    return spark.createDataFrame(points, "id long, x long").repartition(3), spark.createDataFrame(bands, "key long, lo long, hi long").repartition(3)


@pytest.mark.parametrize("segment_rows", [None, 50])
def test_counts_of_intervals_equal_their_pairs(spark, monkeypatch, segment_rows):
    points, bands = interval_sides(spark, 400)
    if segment_rows:
        monkeypatch.setattr(scan, "SEGMENT_ROWS", segment_rows)
    got = {r.key: r.n for r in extensions.interval_counts(points, bands, "x", "lo", "hi", 100, ["key"]).collect()}
    want = {}
    for b in bands.collect():
        if n := sum(b.lo <= p.x < b.hi for p in points.collect() if p.x is not None and b.lo is not None):
            want[b.key] = want.get(b.key, 0) + n
    assert got == want and None in got
    pairs = extensions.interval_join(points, bands, "x", "lo", "hi", 100).groupBy("key").count()
    assert {r.key: r["count"] for r in pairs.collect()} == want


def test_counting_bands_forms_no_pairs(spark, tmp_path):
    """With each side ten times as large no operator of the query makes rows with the product of both."""

    def most_rows(n):
        at = tmp_path / str(n)
        at.mkdir()
        tables = {"supplier": spark.range(n).selectExpr("id AS s_suppkey", "CAST(id % 50 AS double) AS s_acctbal"), "customer": spark.range(n).selectExpr("id AS c_custkey", "CAST(id % 50 AS double) AS c_acctbal")}
        for name, rows in tables.items():
            rows.write.parquet(f"{at}/{name}.parquet")
        df = entry.queries()["ext_interval_join"](spark, str(at))
        assert {r.s_suppkey: r.n for r in df.collect()} == {i: n // 50 * (50 - i % 50) for i in range(n)}
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif node.getClass().getSimpleName().endswith("QueryStageExec"):
                todo.append(node.plan())
            if (rows := node.metrics().get("numOutputRows")).isDefined():
                most = max(most, rows.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most

    small, large = most_rows(100), most_rows(1000)
    assert 0 < small and large <= 10 * small
