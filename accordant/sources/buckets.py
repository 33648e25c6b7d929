"""Tables in buckets: rows of one key in one file, so that joins on the key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from accordant.session import scratch_path


def write_bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write a table to the shared folder in buckets of ``key`` and read it back.

    ``buckets`` defaults to the session's number of shuffle partitions.  Tables to
    be joined without a shuffle need the same number.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)
