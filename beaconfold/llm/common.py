"""Small helpers that the operations share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many characters inside a task, so
#: that a task's memory follows the slice and not the partition.
SLICE_CHARS = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master gets a folder of its own; any
    other master has to name one, since executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}") if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"file://{own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage in a way that survives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored`."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session's Arrow batches hold at most ``rows`` rows, since a row may hold a long text.

    All operations use this one bound, and a smaller one of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def with_text_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``key`` as text: pandas would turn a batch of integers with a null into floats and lose digits."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(key, F.col(key).cast("string"))


def with_long_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The other way round."""
    return df.withColumn(key, F.col(key).cast("long"))


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def filled(texts) -> list[str]:
    """A text column's values with empty strings for nulls."""
    return [t if isinstance(t, str) else "" for t in texts]
