"""Tables that many queries read, written once per session and state of the input folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on a local master, where that is unset, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = (spark.sparkContext.applicationId, "folder")
    if key not in _TABLES:
        _TABLES[key] = tempfile.mkdtemp(prefix="panel-")
    return _TABLES[key]


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _input_state(spark: SparkSession, folder: str) -> int:
    """When the newest table of an input folder, or a file in one, was written."""
    path, fs = _filesystem(spark, folder)
    found = [s for p in (path, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*")) for s in (fs.globStatus(p) or [])] + list(fs.listStatus(path) if fs.exists(path) else [])
    return max((s.getModificationTime() for s in found), default=0)


def materialised(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], *partitions: str) -> DataFrame:
    """The table that ``make`` gives for an input folder, written as Parquet at its first use in a session.

    It is written anew once the input folder's tables change; ``release`` removes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _input_state(spark, sf_dir), name)
    if key not in _TABLES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        made = make()
        (made.repartition(*partitions) if partitions else made).write.partitionBy(*partitions).parquet(path)
        _TABLES[key] = (path, made.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def held(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether this session has the table as the input folder now is."""
    return (spark.sparkContext.applicationId, sf_dir, _input_state(spark, sf_dir), name) in _TABLES


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession, sf_dir: str | None = None) -> int:
    """Removes the tables that this session has written, of one input folder or of all; gives how many."""
    mine = [k for k in _TABLES if k[0] == spark.sparkContext.applicationId and len(k) == 4 and sf_dir in (None, k[1])]
    for key in mine:
        path, fs = _filesystem(spark, _TABLES.pop(key)[0])
        fs.delete(path, True)
    return len(mine)
