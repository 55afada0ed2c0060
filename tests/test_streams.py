"""Streams over several batches and restarts, against the SQL of one pass and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from beaconfold.operators.events import consents
from beaconfold.plans import changes
from beaconfold.plans.catalog import ORACLE
from beaconfold.sources import sinks
from beaconfold.streaming import metrics, operations, queries
from differential import assert_same, connect

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()


def write(spark, folder, pdf, n):
    """A file of its own; later files have later names and times."""
    at = folder / f"part-{n}.parquet"
    pdf.to_parquet(at, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    return at


@pytest.fixture
def folder(spark, events, tmp_path):
    """The events in files by time: a table that is a folder, without its last part yet."""
    table = tmp_path / "events.parquet"
    table.mkdir()
    third = len(events) // 3
    pieces = [events[:third], events[third : 2 * third], events[2 * third :]]
    for n, pdf in enumerate(pieces[:2]):
        write(spark, table, pdf, n)
    return tmp_path, table, pieces


def later(spark, folder):
    _, table, pieces = folder
    write(spark, table, pieces[2], 2)


STREAMS = {
    "stream_operations": lambda s, d, b: queries.stream_operations(s, d, base=b, files_per_batch=1),
    "stream_ends": lambda s, d, b: queries.stream_ends(s, d, base=b, files_per_batch=1),
    "stream_consents": lambda s, d, b: queries.stream_consents(s, d, base=b, files_per_batch=1),
    "stream_counts": lambda s, d, b: queries.stream_counts(s, d, base=b, files_per_batch=1),
    "stream_lifecycle": lambda s, d, b: queries.stream_lifecycle(s, d, base=b, files_per_batch=1),
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_batches_and_a_restart_give_the_rows_of_one_pass(spark, folder, tmp_path, name):
    run, base = STREAMS[name], f"file://{tmp_path}/state"
    sf_dir = str(folder[0])
    first = run(spark, sf_dir, base).count()
    later(spark, folder)
    got = run(spark, sf_dir, base)  # goes on with the third file
    assert_same(got, connect(SF), ORACLE[name])
    assert first > 0
    assert_same(run(spark, sf_dir, base), connect(SF), ORACLE[name])  # nothing new, nothing lost


def test_old_states_go(spark, folder, tmp_path):
    later(spark, folder)
    queries.stream_lifecycle(spark, str(folder[0]), base=f"file://{tmp_path}/state", files_per_batch=1).count()
    assert sorted(p.name for p in (tmp_path / "state" / "state").iterdir()) == ["1", "2"]


def test_timeouts_of_the_stream_are_those_of_the_table(spark):
    """Every operation that a day's limit and the watermark have settled has the status that the batch query gives it."""
    got = {r.event_id: r.status for r in changes.stream_operations(spark, SF).collect()}
    want = {r.event_id: r.status for r in entry.queries()["timeouts"](spark, SF).collect()}
    assert -11 in got.values() and got == {k: want[k] for k in got}


def plain_operations(rows, start, ends, limit, now):
    out = []
    for us, event_id, slot, kind in rows:
        if kind == start and us <= now:
            end = min(((u, e) for u, e, s, k in rows if s == slot and k in ends and (u, e) > (us, event_id) and u <= now), default=None)
            if end and end[0] - us <= limit:
                out.append((slot, event_id, end[0] - us, 0))
            elif end or us + limit < now:
                out.append((slot, event_id, None, -11))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(20))
def test_settling_in_steps_equals_one_pass(seed):
    """However often a device is woken, and in whatever order its events arrive before the watermark, the results are those of a loop over all."""
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 300), i, rnd.randint(0, 2), rnd.choice([1, 2, 512])) for i in range(60)]
    waiting, flying, out, at = [], [], [], 0
    left = list(rows)
    for now in sorted(rnd.sample(range(400), 5)):
        ready = [r for r in left if r[0] <= now + rnd.randint(0, 40)]
        left = [r for r in left if r not in ready]
        rnd.shuffle(ready)
        done, waiting, flying = operations.settled(waiting + ready, flying, now, 1, 50)
        out, at = out + done, now
    assert sorted(out, key=str) == plain_operations(rows, 1, {2, 512}, 50, at)


def made(spark, table, rows, n):
    df = spark.createDataFrame([(e, t, d, k, 1.0, f'{{"k": {s}}}') for e, t, d, k, s in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas().to_parquet(table / f"part-{n}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)


def test_a_timer_fires_without_a_later_event_of_the_device(spark, tmp_path):
    table = tmp_path / "events.parquet"
    table.mkdir()
    made(spark, table, [(1, "2024-01-01 00:00:00", 7, "signup", 1), (2, "2024-01-01 01:00:00", 8, "signup", 1)], 0)
    made(spark, table, [(3, "2024-01-01 02:00:00", 8, "purchase", 1), (4, "2024-01-03 12:00:00", 9, "view", 1), (5, "2024-01-03 12:00:00", 9, "error", 1)], 1)
    got = queries.stream_operations(spark, str(tmp_path), base=f"file://{tmp_path}/b", files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == [(7, 1, 1, None, -11), (8, 1, 2, 3_600_000_000, 0)]


@pytest.mark.parametrize("shards", [1, 3])
def test_calls_follow_shards_and_not_devices(spark, folder, tmp_path, monkeypatch, shards):
    """Timers, each of which is a call and a state to read, keep to the shards however many devices there are."""
    monkeypatch.setattr(operations, "SHARDS", shards, raising=False)
    later(spark, folder)
    timers = []
    heard = operations.operations(queries.event_stream(spark, str(folder[0])), 1, [2, 512], DAY, "1 hour")
    with operations.keyed_state(spark):
        query = heard.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    for progress in query.recentProgress:
        timers += [s.customMetrics["numRegisteredTimers"] for s in progress.stateOperators]
    assert_same(spark.read.schema(heard.schema).parquet(f"{tmp_path}/out"), connect(SF), ORACLE["stream_operations"])
    assert 0 < sum(timers) <= 4 * shards


def test_late_and_repeated_ends_go(spark, tmp_path):
    table = tmp_path / "events.parquet"
    table.mkdir()
    made(spark, table, [(1, "2024-01-01 00:00:00", 7, "purchase", 1), (2, "2024-01-02 00:00:00", 7, "purchase", 1)], 0)
    made(spark, table, [(3, "2024-01-02 06:00:00", 7, "error", 1), (2, "2024-01-02 00:00:00", 7, "purchase", 1)], 1)  # 2 is delivered again
    made(spark, table, [(4, "2024-01-01 12:00:00", 7, "error", 1), (5, "2024-01-02 05:30:00", 7, "error", 1)], 2)  # 4 is behind the watermark, 5 isn't
    got = queries.stream_ends(spark, str(tmp_path), base=f"file://{tmp_path}/b", files_per_batch=1)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 5]


def test_only_prompts_that_require_consent_get_one(spark):
    rows = [(1, 0, 10, True), (1, 1, 11, False), (2, 0, 12, None), (None, None, 13, True)]
    prompts = spark.createDataFrame(rows, "device_id long, slot int, event_id long, consent_required boolean").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = sorted(consents(prompts).collect(), key=lambda r: r.event_id)
    assert [(r.device_id, r.event_id, r.granted) for r in got] == [(1, 10, True), (None, 13, True)]
    assert got[0].line == "[2024-01-02 03:04:05] [INFO ] [listener] User consent required — auto-providing consent"


def test_stream_of_subscriptions_equals_the_batch_query(spark):
    got = sorted(map(tuple, changes.stream_subscriptions(spark, SF).select("event_id", "sub_id").collect()))
    assert got and got == sorted(map(tuple, entry.queries()["changing_subscriptions"](spark, SF).select("event_id", "sub_id").collect()))


def test_leases_cover_each_subscription_once(spark):
    subs = spark.createDataFrame([(1, 7, "2024-01-01 06:00:00", "2024-01-03 18:00:00"), (2, 1, "2024-01-01", None), (3, 1, "2024-02-01", "2024-01-01")], "sub_id long, mask long, since string, until string")
    subs = subs.withColumn("since", F.to_timestamp("since")).withColumn("until", F.to_timestamp("until"))
    rows = sorted((r.sub_id, str(r.since), str(r.until)) for r in operations.leases_of(subs, "2024-01-03").collect())
    assert rows == [
        (1, "2024-01-01 06:00:00", "2024-01-02 06:00:00"), (1, "2024-01-02 06:00:00", "2024-01-03 06:00:00"), (1, "2024-01-03 06:00:00", "2024-01-03 18:00:00"),
        (2, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, "2024-01-02 00:00:00", "2024-01-03 00:00:00"),
    ]


def test_counters_reach_a_callback_for_each_batch(spark, folder, tmp_path):
    later(spark, folder)
    heard, called = {}, []
    listener = metrics.MetricsListener("types", lambda batch, m: heard.update({batch: m}))
    spark.streams.addListener(listener)
    try:
        queries.stream_counts(spark, str(folder[0]), called=called.append, base=f"file://{tmp_path}/b", files_per_batch=1)
        stream = metrics.observed_types(queries.event_stream(spark, str(folder[0]), 1).select("type", "status"), "types")
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(heard) >= 3:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert len(called) == 3 and sum(m["n_1"] for m in called) == sum(m["n_1"] for m in heard.values()) > 0


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    out, ledger, seen = f"file://{tmp_path}/out", f"file://{tmp_path}/ledger", []
    write, batch = sinks.recorded(out), spark.range(10).toDF("id")

    def failing(df, n):
        write(df, n)
        seen.append(n)
        if len(seen) == 1:
            raise OSError("lost after writing")

    run = sinks.once(failing, ledger)
    with pytest.raises(OSError):
        run(batch, 0)
    run(batch, 0)  # runs anew and replaces what was written
    run(batch, 0)  # done: nothing happens
    run(spark.range(10, 15).toDF("id"), 1)
    assert seen == [0, 0, 1]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))


def test_attach_and_detach(spark, folder, tmp_path):
    """A sink that is attached gets what is there; a detached one gets no more; attached again, it goes on."""
    out = f"file://{tmp_path}/out"
    lines = lambda: queries.event_stream(spark, str(folder[0])).select("event_id")
    at = str(tmp_path / "at")
    sinks.attach(lines(), sinks.once(sinks.recorded(out), f"file://{tmp_path}/ledger"), at).awaitTermination()
    before = spark.read.parquet(f"{tmp_path}/out").count()
    assert before == sum(len(p) for p in folder[2][:2])
    paced = sinks.attach(lines(), sinks.recorded(out), at, every="100 milliseconds")
    paced.stop()
    later(spark, folder)
    assert spark.read.parquet(f"{tmp_path}/out").count() == before
    sinks.attach(lines(), sinks.recorded(out), at).awaitTermination()
    ids = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").select("event_id").collect()]
    assert len(ids) == len(set(ids)) == sum(map(len, folder[2]))
    sinks.attach(lines(), None, str(tmp_path / "console")).awaitTermination()
