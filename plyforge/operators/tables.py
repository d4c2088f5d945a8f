"""Tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="plyforge-"))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/plyforge/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the hash of its keys in as many partitions as its counted rows need, `rows` each, or in the session's number if that is more.

    What windows, groups and joins of these keys then sort or hash in a task doesn't grow with the table, if no key's rows do.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
