"""Streams: the latest visible version of each event, and daily bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

KEYS = ("security_id", "event_id")
BUCKETS = 16
WHOLE = 20


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each event; versions carry their own time of publication, so the order of arrival doesn't matter."""
    facts = [c for c in rows.columns if c not in KEYS]
    order = F.struct("published_at", "version")
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*facts), order).alias("f")).select(*KEYS, "f.*")


def merge_batch(batch: DataFrame, number: int, path: str, buckets: int = BUCKETS) -> None:
    """Merges one micro-batch into the state under ``path``: ``state/batch=<number>`` holds the buckets that it changed.

    A bucket (a hash of the event) is rewritten from its newest earlier state and the batch. Writing a batch again replaces its
    own folder and reads only earlier, finished ones, so a repeated batch, after a failure or a restart, gives the same state.
    Every WHOLE batches all buckets are rewritten; folders older than the rewriting before the last are then removed.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    whole = number % WHOLE == 0
    touched = list(range(buckets)) if whole else [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = _newest_folders(spark, path, batch, number)
    if old is not None:
        rows = rows.unionByName(old.where(F.col("bucket").isin(touched)))
    merged = newest(rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/batch={number}")
    if whole:
        for n in _finished(spark, path):
            if n < number - WHOLE:
                _remove(spark, f"{path}/state/batch={n}")


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folders were written to the end: at most two times WHOLE."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/batch=*/_SUCCESS")) or []] if fs.exists(p) else []
    return sorted(int(f.getParent().getName().split("=")[1]) for f in found)


def _remove(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _newest_folders(spark: SparkSession, path: str, like: DataFrame, before: int | None = None) -> DataFrame | None:
    """Rows of each bucket from the newest finished batch that wrote it, of batches before ``before``."""
    numbers = [n for n in _finished(spark, path) if before is None or n < before]
    if not numbers:
        return None
    schema = StructType([*like.schema.fields, StructField("bucket", IntegerType()), StructField("batch", IntegerType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/state").parquet(*(f"{path}/state/batch={n}" for n in numbers))
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # partition columns only
    return rows.join(F.broadcast(last), ["bucket", "batch"], "left_semi").drop("batch")  # a row a bucket


def latest_visible_stream(versions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, merge: Callable = merge_batch) -> StreamingQuery:
    """Keeps the newest version of each event of a stream (security_id, event_id, published_at, version, ...) under ``path``."""
    writer = versions.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def visible_state(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The state as of the last finished batch; empty before the first."""
    found = _newest_folders(spark, path, like)
    return like.limit(0) if found is None else found.select(*like.columns)
