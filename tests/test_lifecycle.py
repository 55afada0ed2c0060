import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconfold.operators import kpi, lifecycle
from beaconfold.operators.registry import appeared, renamed, upsert
from beaconfold.streaming.queries import STATE, active_slots, merged, step, stream_lifecycle

SCHEMA = "device_id long, event_id long, ts long, slot int, type long"


def random_events(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.randint(1, 5), i, i // 3, rnd.randint(0, 3), rnd.choice([1, 2, 2, 4, 8])) for i in range(n)]


def folded(rows):
    state = {}
    for device, _, _, slot, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        installed, active = state.setdefault(device, [set(), -1])
        state[device][1] = step(installed, active, slot, kind)[0]
    return {d: a for d, (_, a) in state.items() if a >= 0}


@pytest.mark.parametrize("seed", range(5))
def test_batch_fold_equals_sequential_fold(spark, seed):
    rows = random_events(seed)
    got = lifecycle.active_profiles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.device_id for r in got}) == len(got)  # one active profile at most
    assert {r.device_id: r.slot for r in got} == folded(rows)


@pytest.mark.parametrize("seed", range(3))
def test_states_merged_batch_by_batch_equal_sequential_fold(spark, seed):
    rows = random_events(seed, 240)
    cuts = [0, *sorted(random.Random(seed).sample(range(240), 2)), 240]
    state = spark.createDataFrame([], STATE)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(random.Random(n).sample(rows[a:b], b - a), SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
        state = spark.createDataFrame(merged(state, part, n).collect(), STATE)
    assert {r.device_id: r.slot for r in active_slots(state).collect()} == folded(rows)


def test_stream_goes_by_time_where_ids_do_not(spark, tmp_path):
    names = ["signup", "purchase", "click"]
    rnd = random.Random(9)
    rows = [(rnd.randint(1, 4), 5000 - i, 1_000_000 + i, rnd.randint(0, 3), rnd.randint(0, 2)) for i in range(300)]  # ids fall with time
    events = spark.createDataFrame([(e, t, d, names[k], 0.0, f'{{"k": {slot}}}') for d, e, t, slot, k in rows], "event_id long, ts long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.device_id: r.slot for r in stream_lifecycle(spark, str(tmp_path)).collect()}
    assert got == folded([(d, e, t, slot, 1 << k) for d, e, t, slot, k in rows])


def test_rules_of_a_step():
    installed = set()
    assert step(installed, -1, 3, 2) == (-1, -7)  # enabling what isn't there
    assert step(installed, -1, 3, 1) == (-1, 0)
    assert step(installed, -1, 3, 2) == (3, 0)
    assert step(installed, 3, 2, 4) == (3, 0)  # disabling another one
    assert step(installed, 3, 3, 8) == (-1, 0)
    assert step(installed, -1, 3, 8) == (-1, -7)


@pytest.mark.parametrize("n", [1, 2, 7, 50, 100, 101, 1000, 12_345])
def test_order_statistics_are_exact(spark, n):
    rnd = np.random.default_rng(n)
    x = np.round(rnd.normal(size=n), 2) if n % 2 else rnd.integers(0, 40, n).astype(float)
    rows = spark.createDataFrame([("a", float(v)) for v in x], "name string, us double")
    got = kpi.order_statistics(rows, ["name"], "us").first()
    s = np.sort(x)
    assert got.n == n and got.median == pytest.approx(np.median(s), abs=1e-12)
    assert got.p99 == s[min(int(n * 0.99), n - 1)] and (got["min"], got["max"]) == (s[0], s[-1])


def test_order_statistics_of_nothing(spark):
    assert kpi.order_statistics(spark.createDataFrame([], "name string, us double"), ["name"], "us").count() == 0


def test_anti_join_is_disjoint(spark):
    a, b = spark.range(10).select(F.col("id").alias("k")), spark.range(5, 15).select(F.col("id").alias("k"))
    assert sorted(r.k for r in appeared(a, b, ["k"]).collect()) == [0, 1, 2, 3, 4]


def test_upsert_and_nickname(spark):
    rows = spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "iccid_hex string, at int, nickname string")
    new = spark.createDataFrame([("y", 2, "c"), ("z", 1, "d")], rows.schema)
    both = upsert(rows, new, "iccid_hex", "at")
    assert {r.iccid_hex: r.nickname for r in both.collect()} == {"x": "a", "y": "c", "z": "d"}
    named = renamed(both, spark.createDataFrame([("x", "N")], "iccid_hex string, nickname string"))
    assert {r.iccid_hex: r.nickname for r in named.collect()} == {"x": "N", "y": "c", "z": "d"}


def test_bench_counts_no_warm_up():
    calls = []
    assert len(kpi.bench("x", 5, lambda: calls.append(1))) == 5 and len(calls) == 8


def test_differences_of_expected_and_actual(spark):
    from beaconfold.operators.conformance import differences

    schema = "id long, a int, b string"
    expected = spark.createDataFrame([(1, 1, "x"), (2, None, None), (3, 1, "x"), (4, 1, "x"), (None, 1, "y")], schema)
    actual = spark.createDataFrame([(1, 1, "x"), (2, None, None), (3, 2, None), (5, 1, "x"), (None, 2, "y")], schema)
    got = {r.id: (r.failed, r.passed) for r in differences(expected, actual, ["id"], ["a", "b"]).collect()}
    assert got == {1: ("", True), 2: ("", True), 3: ("a,b", False), 4: ("missing", False), 5: ("unexpected", False), None: ("a", False)}
    assert differences(expected.where("false"), actual.where("false"), ["id"], ["a"]).count() == 0
