"""Readers: tables, and the panel inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts at once where rows are dealt by a key: some 30 MB, whatever the table's size and the session's settings.
ROWS_A_TASK = 250_000
#: Spark's spark.shuffle.sort.bypassMergeThreshold: up to so many partitions a task deals the rows of its split without sorting them.
UNSORTED = 200


def deals(spark: SparkSession, rows: int, a_task: int = ROWS_A_TASK) -> int:
    """Partitions for so many rows: as many as there are cores, and more as rows grow, so that a task's share stays the same."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // a_task))


def scan_range(spark: SparkSession, path: str, start: str, end: str, columns: list[str], date: str = "date") -> DataFrame:
    """Projected rows of a date range [start, end); both reach the Parquet scan."""
    rows = spark.read.parquet(path).where((F.col(date) >= F.lit(start).cast("timestamp")) & (F.col(date) < F.lit(end).cast("timestamp")))
    return rows.select(*columns)


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 0")


def bar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security_id, date) of the weekly bars, repeats included: what only needs these gathers no bars."""
    return _traded(spark, sf_dir).select(F.col("l_suppkey").alias("security_id"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar per supplier and week of shipping; the price is the extended price per unit."""
    rows = _traded(spark, sf_dir).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    count = table(spark, sf_dir, "lineitem").count()  # from the footers; sessions with few partitions would sort, and spill, more with every row
    n = max(min(deals(spark, count), UNSORTED), deals(spark, count, 5 * ROWS_A_TASK))  # a sort of whole splits would spill too
    rows = rows.repartition(n, "l_suppkey")  # hardly two rows of a bar lie together, so rows are dealt instead of partial bars
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        rows.groupBy(F.col("l_suppkey").alias("security_id"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max_by(price, order).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        )
    )


def calendar(bars: DataFrame) -> DataFrame:
    """(date, pos): the sessions, numbered from 0. Only distinct dates meet in the unpartitioned window."""
    days = bars.select("date").distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


def dense_panel(bars: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every session from a security's first to its last bar; ``quoted`` tells whether a bar is there.

    Each bar is unfolded up to the session before the security's next one, so bars are dealt by security once and the
    windows over its sessions need no other exchange. ``keys`` are the keys of the bars (repeats do no harm), where they are cheaper
    to have than from the bars.
    """
    days = F.broadcast(calendar(bars if keys is None else keys))  # a row a session
    own = Window.partitionBy("security_id").orderBy("pos")
    spans = bars.join(days, "date").withColumn("_until", F.greatest(F.lead("pos").over(own) - 1, F.col("pos")))
    grid = spans.withColumn("_at", F.explode(F.sequence("pos", "_until")))
    here = (F.col("_at") == F.col("pos")) & F.col("security_id").isNotNull()
    values = [c for c in bars.columns if c not in ("security_id", "date")]
    panel = grid.select("security_id", F.col("_at").alias("pos"), *(F.when(here, F.col(c)).alias(c) for c in values)).join(days, "pos")
    return panel.select("security_id", "date", "pos", *values).withColumn("quoted", F.col("close").isNotNull())


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel of the weekly bars."""
    return dense_panel(weekly_bars(spark, sf_dir), bar_keys(spark, sf_dir))
