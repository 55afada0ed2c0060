"""Folders that driver and executors share: state of streams, sources and ledgers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


def stream_dir(spark: SparkSession, named: str | None = None) -> str:
    """The folder of a stream's output and checkpoint: the caller's, with which a restart goes on, or a new one."""
    return named.rstrip("/") if named else f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file."""
    at, fs = _at(spark, path)
    fs.create(at, True).close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def source_folder(spark: SparkSession, table: str) -> tuple[str, str]:
    """The folder and the pattern of names by which a stream reads a table that may be a file or a folder of files."""
    at, fs = _at(spark, table)
    if fs.getFileStatus(at).isDirectory():
        return table, "*.parquet"
    return table.rsplit("/", 1)[0], table.rsplit("/", 1)[1]
