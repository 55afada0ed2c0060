import json
import socket
import threading

from beaconfold.sources import files, sinks
from beaconfold.streaming.queries import stream_windows


def test_marked_json(spark, tmp_path):
    rows = [{"name": "x", "mean_us": 1.5, "median_us": 1.0, "p99_us": 2.0, "min_us": 1.0, "max_us": 2.0, "iterations": 3}]
    path = tmp_path / "out.txt"
    path.write_text("noise\n__BENCH_JSON_BEGIN__\n" + json.dumps(rows) + "\n__BENCH_JSON_END__\nmore")
    got = files.marked_json(spark, str(path)).collect()
    assert [(r.name, r.median_us, r.iterations) for r in got] == [("x", 1.0, 3)]


def test_tool_output(spark):
    sizes = spark.createDataFrame([("text data bss dec hex filename\n 51712 1126 80 52918 ceb6 lib.so",)], "value string")
    assert {r.name: r.value for r in files.size_columns(sizes).collect()} == {"text": 51712, "data": 1126, "bss": 80, "dec": 52918}
    lines = spark.createDataFrame([("0001 T f",), ("0002 t g",), ("\tlibc.so.6 => /lib/libc.so.6 (0x1)",), ("\tlinux-vdso.so.1 (0x2)",)], "value string")
    assert files.exported_symbols(lines).first().n_symbols == 1
    assert sorted(r.library for r in files.needed_libraries(lines).collect()) == ["libc.so.6", "linux-vdso.so.1"]


def test_tcp_sink_sends_lines_and_survives_a_missing_peer(spark):
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def serve():
        peer, _ = server.accept()
        with peer:
            while data := peer.recv(4096):
                got.append(data)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    lines = spark.createDataFrame([("one",), ("two",)], "line string").coalesce(1)
    sinks.tcp_lines("127.0.0.1", server.getsockname()[1])(lines, 0)
    thread.join(10)
    server.close()
    assert b"".join(got) == b"one\ntwo\n"
    sinks.tcp_lines("127.0.0.1", 1, timeout=0.2)(lines, 1)  # nobody listens


def test_windows_with_watermark(spark):
    rows = stream_windows(spark, "/root/testdata/sf0.001").collect()
    assert len({(r.day, r.type) for r in rows}) == len(rows)


def test_completion_callback(spark, tmp_path):
    from beaconfold.streaming.listeners import CompletionListener

    ended = threading.Event()
    seen = []
    listener = CompletionListener(lambda query, error: (seen.append((query, error)), ended.set()))
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert ended.wait(20) and (str(query.id), None) in seen
    finally:
        spark.streams.removeListener(listener)
