"""Versioned tables: immutable data folders, and a log of entries that alone makes them visible.

A version is written whole to a folder of its own, checked, and then published by one entry ``log/<number>.json``, put in place by a
rename that fails if the number is taken. So a failed or unfinished write is never visible, two writers can't both get a
number, and a reader that holds an entry keeps reading the same files whatever is published later.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_ENTRY = "{:010d}.json"


def _hadoop(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, root: str) -> list[dict]:
    """All published entries, oldest first; a row each was published, so they are few."""
    path, fs, _ = _hadoop(spark, root)
    log = path(f"{root}/log")
    if not fs.exists(log) or not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(log)):
        return []
    rows = spark.read.text(f"{root}/log/*.json", wholetext=True).select("value", F.input_file_name().alias("file")).collect()
    return [json.loads(r.value) for r in sorted(rows, key=lambda r: r.file.rsplit("/", 1)[-1])]


def current(spark: SparkSession, root: str, version: str | None = None) -> dict:
    """The newest entry, or the one of a version."""
    found = [e for e in entries(spark, root) if version in (None, e["version"])]
    if not found:
        raise LookupError(f"nothing is published under {root}" + (f" as {version}" if version else ""))
    return found[-1]


def read(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The published table, pinned to one version: its files do not change under the reader."""
    entry = current(spark, root, version)
    return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{root}/{entry['folder']}")


def publish(rows: DataFrame, root: str, version: str, keys: list[str], rules: dict[str, str] | None = None, facts: dict[str, str] | None = None, partitions: tuple[str, ...] = ()) -> dict:
    """Writes a version and makes it visible; gives its entry.

    Refused, with nothing published: unsafe or taken names, an empty table, null or repeated ``keys``, rows that break one of
    ``rules`` (SQL conditions that must hold). ``facts`` maps names to SQL aggregates that go into the entry. The checks read
    what was written, in one pass beside the one that looks for repeated keys.
    """
    spark = rows.sparkSession
    if not _NAME.fullmatch(version) or ".." in version:
        raise ValueError(f"unsafe version name {version!r}")
    before = entries(spark, root)
    if any(e["version"] == version for e in before):
        raise ValueError(f"version {version} is published already")
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partitions).parquet(f"{root}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/{folder}")
    broken = [F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(f"rule {n}") for n, e in (rules or {}).items()]
    nulls = F.count_if(F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()).alias("rule known_keys")
    found = written.agg(F.count(F.lit(1)).alias("rows"), nulls, *broken, *(F.expr(e).alias(f"fact {n}") for n, e in (facts or {}).items())).first().asDict()
    reasons = [n.removeprefix("rule ") for n, v in found.items() if n.startswith("rule ") and v]
    reasons += ["not_empty"] * (not found["rows"])
    if not reasons and written.groupBy(*keys).count().where("count > 1").head(1):
        reasons.append("unique_keys")
    if reasons:
        raise ValueError(f"version {version} is not published: {', '.join(reasons)}")
    entry = {"version": version, "folder": folder, "rows": found["rows"], "facts": {n.removeprefix("fact "): v for n, v in found.items() if n.startswith("fact ")}, "schema": rows.schema.jsonValue()}
    _append(spark, root, len(before), entry)
    return entry


def _append(spark: SparkSession, root: str, number: int, entry: dict) -> None:
    path, fs, context = _hadoop(spark, root)
    draft = path(f"{root}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(entry, default=str).encode()))
    finally:
        out.close()
    fs.mkdirs(path(f"{root}/log"))
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(draft, path(f"{root}/log/{_ENTRY.format(number)}"), options)  # fails if another writer took the number


def remove_unpublished(spark: SparkSession, root: str) -> int:
    """Removes data folders that no entry names; for times without writers. Gives how many there were."""
    path, fs, _ = _hadoop(spark, root)
    known = {e["folder"].rsplit("/", 1)[-1] for e in entries(spark, root)}
    data = path(f"{root}/data")
    gone = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in known]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
