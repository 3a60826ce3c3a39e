"""Exact positions in a large order without one sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, keys: tuple[str, ...], value: str, ties: tuple[str, ...], width: float) -> DataFrame:
    """Adds ``position`` (from 1, by value, then ties) and ``n`` within each group of ``keys``.

    Values fall into buckets of ``width``; bucket counts give each bucket's first position, and only a bucket's rows
    are sorted together. Rows without a value are left out.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumn("_bucket", F.floor(F.col(value) / width))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"), F.sum("_count").over(Window.partitionBy(*keys)).alias("n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value, *ties)
    placed = rows.join(counts, [*keys, "_bucket"]).withColumn("position", F.col("_base") + F.row_number().over(inside))
    return placed.drop("_bucket", "_base")


def equal_bins(position, n, bins: int):
    """The bin (from 1) of a position when n rows are cut into ``bins`` runs, the longer runs first."""
    size, longer = F.floor(n / bins), n % bins
    head = longer * (size + 1)
    return F.when(position <= head, F.ceil(position / (size + 1))).otherwise(longer + F.ceil((position - head) / F.greatest(size, F.lit(1)))).cast("int")


def bin_sums(rows: DataFrame, keys: tuple[str, ...], value: str, ties: tuple[str, ...], summed: tuple[str, ...], bins: int, width: float) -> DataFrame:
    """(keys, bin, n, ``summed``): counts and sums of ``bins`` equal runs by value, then ties, within each group of ``keys``.

    A bucket of ``width`` that lies in one bin is added up where its rows are; only rows of buckets that an edge cuts, fewer than
    ``bins`` a group, are sorted. Rows without a value are left out.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumn("_bucket", F.floor(F.col(value) / width))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in summed))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_base": F.coalesce(F.sum("n").over(before), F.lit(0)), "_n": F.sum("n").over(Window.partitionBy(*keys))})
    first, last = (equal_bins(p, F.col("_n"), bins) for p in (F.col("_base") + 1, F.col("_base") + F.col("n")))
    counts = counts.withColumns({"bin": first, "_last": last})
    cut = counts.where("bin < _last").select(*keys, "_bucket", "_base", "_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value, *ties)
    placed = rows.join(F.broadcast(cut), [*keys, "_bucket"]).withColumn("bin", equal_bins(F.col("_base") + F.row_number().over(inside), F.col("_n"), bins))
    parts = placed.select(*keys, "bin", F.lit(1).cast("long").alias("n"), *summed).unionByName(counts.where("bin = _last").select(*keys, "bin", "n", *summed))
    return parts.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in ("n", *summed)))
