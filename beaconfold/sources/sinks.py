"""Sinks: line sockets, callbacks and JSON documents."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tcp_lines(host: str, port: int, column: str = "line", timeout: float = 5.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends each row's line to a TCP peer.

    Each partition opens its own connection; lines that can't be sent are
    dropped, since a log sink must not stop the work that it reports on.
    """

    def send(rows: Iterator[Row]) -> None:
        try:
            with socket.create_connection((host, port), timeout) as peer:
                for row in rows:
                    peer.sendall((row[column].rstrip("\n") + "\n").encode())
        except OSError:
            for _ in rows:
                pass

    return lambda df, _batch: df.select(column).foreachPartition(send)


def recorded(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch to a folder of its own, ``batch=<id>`` under ``path``.

    A batch that is run again replaces what it wrote before, so it adds no row.
    """
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def once(sink: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """``sink`` behind a ledger: a batch that ended well isn't handed to it again.

    The ledger is a shared folder with an empty file for each batch that is done.
    A batch that failed on its way has none and runs anew, so a sink that can't
    take rows back (a socket) gets them at least once, and one that replaces a
    batch's rows (:func:`recorded`) has them exactly once.
    """
    from ..streaming.folders import exists, mark

    def run(df: DataFrame, batch: int) -> None:
        done = f"{ledger}/{batch}.done"
        if not exists(df.sparkSession, done):
            sink(df, batch)
            mark(df.sparkSession, done)

    return run


def attach(lines: DataFrame, sink: Callable[[DataFrame, int], None] | None, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a stream of lines into ``sink``, or to the console if there is none; ``stop()`` of the result detaches it.

    With ``every`` ("100 milliseconds") batches start at that pace; without it
    the stream ends once it has what is there.
    """
    writer = lines.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("console").option("truncate", "false")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def bench_document(results: DataFrame, begin: str = "__BENCH_JSON_BEGIN__", end: str = "__BENCH_JSON_END__") -> DataFrame:
    """One text ``value`` with all ``results`` (a row for each benchmark) as a JSON array between two marks, times with two decimals.

    The table of benchmarks is as long as the list of their names.
    """
    times = [c for c in results.columns if c not in ("name", "iterations")]
    row = F.concat(
        F.lit('{"name": '), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2),
        *(F.format_string(f', "{c}": %.2f', F.col(c).cast("double")) for c in times),
        F.format_string(', "iterations": %d}', F.col("iterations").cast("long")),
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))), lambda x: x["row"]), ",\n")
    return results.agg(F.concat(F.lit(f"{begin}\n["), rows, F.lit(f"]\n{end}\n")).alias("value"))


def diagnostics(registry: DataFrame, info: dict[str, str]) -> DataFrame:
    """One JSON document for each device: constants, the profile count and the nested profiles."""
    profile = F.struct("slot", "iccid_hex", "state")
    return registry.groupBy("device_id").agg(
        F.to_json(
            F.struct(
                *(F.lit(v).alias(k) for k, v in info.items()),
                F.count("*").alias("profile_count"),
                F.array_sort(F.collect_list(profile)).alias("profiles"),
            )
        ).alias("document")
    )
