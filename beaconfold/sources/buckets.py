"""Tables that are stored in buckets of a key, for joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

BUCKETS = 8


def bucketed(rows: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` as a table in the warehouse with ``buckets`` sorted buckets of ``key``.

    Two such tables of one number of buckets join on the key bucket by bucket.
    The rows are dealt once before they are written, so a bucket is one file; a
    registry that is asked often is written once and keeps its name.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)
