"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Sizes are words. Sources, ordered by code point with null last, take the weights 1, 2, 3 in turn and share the
   total; a target stops at ``most`` times its source's size and the excess is shared again by weight. The
   water level is found in closed form from running sums over the sources ordered by size per weight.
2. A source whose target is ``c + p`` times its size takes ``c`` certain whole copies of each document.
3. The fraction is drawn by Pareto order sampling: documents are ranked by their random odds u / (1 - u) divided
   by the inclusion odds p / (1 - p), and the source takes the lowest ranks until its words are nearest to the rest
   of its target. u comes from a hash of the seed and the document, so reruns agree.

Ranks are not sorted within a source: they fall into quantile bins of some thousand documents, running sums over
the bins find each source's last bin, and only inside those are documents sorted. A source with a third of all
rows is thus spread over many bins.

Null texts have size 0 and take 0. Repeated rows are drawn one by one (rows equal in every column draw alike). An
empty table gives an empty result. A source without words has the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import durable, free_name, table

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
BIN_ROWS = 4096
BROADCAST_SOURCES = 50_000  # rows of a few numbers: some megabytes
WORDS = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of an MD5: portable and repeatable."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, source_docs, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1).cast("double"))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "share", (F.col("total") - F.coalesce(F.sum(F.col("source_size") * most).over(earlier), F.lit(0))) / F.sum("weight").over(onward)
    )  # what a unit of weight gets if all earlier sources are at their stop: it rises up to the true level and falls after it
    target = F.least(F.col("weight") * F.max("share").over(everything), F.col("source_size") * F.lit(float(most)))
    return per.select("source", "source_size", "source_docs", target.alias("target"))


def _per_source(df: DataFrame) -> DataFrame:
    """Broadcast while it is known to be small; else Spark joins it like any table."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def mixing_plan(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """A row per source: target, certain copies, inclusion probability, and where its ranking is cut.

    ``sizes``: (id, source, size). A document takes another copy if its bin lies before ``last_bin``, or if it
    lies in that bin and its rank is at most ``cut`` or equals ``extra``.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes).withColumn("whole", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = durable(targets.withColumn("bins", F.ceil(F.col("source_docs") / BIN_ROWS)))
    drawn = sizes.withColumnRenamed("source", "_s").join(_per_source(targets), F.col("_s").eqNullSafe(F.col("source"))).where("p > 0")
    drawn = drawn.select("source", "size", "need", rank_of("id", seed).alias("rank"), bin_of("id", seed).alias("bin"))
    per_bin = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    along = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    last = durable(
        per_bin.where("before < need AND before + words >= need")
        .groupBy("source")
        .agg(F.min("bin").alias("last_bin"), F.min_by("before", "bin").alias("before"))
    )
    own = _per_source(last.withColumnRenamed("source", "_s"))
    inside = drawn.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("last_bin")))
    units = inside.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("need").alias("need"), F.first("before").alias("before"))
    up_to = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one bin's documents
    units = units.withColumn("sum", F.col("before") + F.sum("size").over(up_to)).withColumn("fits", F.col("sum") <= F.col("need"))
    reached = F.coalesce(F.max(F.when(F.col("fits"), F.col("sum"))).over(Window.partitionBy("source")), F.col("before"))
    units = units.withColumn("gap", F.col("need") - reached).withColumn("off", F.abs(F.col("size") - F.col("gap")))
    cuts = units.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.col("rank"))), F.lit(-1.0)).alias("cut"),
        F.min(F.when(~F.col("fits") & (F.col("off") < F.col("gap")), F.struct("off", "rank")))["rank"].alias("extra"),
    )
    out = targets.join(last.select(F.col("source").alias("_s"), "last_bin"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def rank_of(id_column: str, seed: str) -> Column:
    """Random odds divided by the odds of inclusion."""
    u = uniform(F.col(id_column), seed)
    return F.try_divide(u / (1 - u), F.try_divide(F.col("p"), 1 - F.col("p")))


def bin_of(id_column: str, seed: str) -> Column:
    return F.floor(uniform(F.col(id_column), seed) * F.col("bins"))


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, size: str | None = None) -> DataFrame:
    """docs with the columns size, source_size, target, copies and taken (present ones are replaced).

    The text is not shuffled: the plan of a row per source is joined to the rows, and a row's copies follow from
    its own hash. ``size``: a column that already holds the words.
    """
    words, plan_name = free_name(docs.columns, "_size"), free_name(docs.columns, "_plan")
    rows = docs.withColumn(words, F.col(size) if size else words_in(text))
    sizes = rows.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(words).alias("size"))
    plan = durable(mixing_plan(durable(sizes), seed)).select(
        F.struct("source", "source_size", "target", "whole", "p", "bins", "last_bin", "cut", "extra").alias(plan_name)
    )
    met = rows.join(_per_source(plan), F.col(source).eqNullSafe(F.col(f"{plan_name}.source")))
    u = uniform(F.col(id_column), seed)
    p, bins = F.col(f"{plan_name}.p"), F.col(f"{plan_name}.bins")
    at, rank = F.floor(u * bins), F.try_divide(u / (1 - u), F.try_divide(p, 1 - p))
    more = (p > 0) & (F.col(f"{plan_name}.last_bin").isNull() | (at < F.col(f"{plan_name}.last_bin")) | ((at == F.col(f"{plan_name}.last_bin")) & ((rank <= F.col(f"{plan_name}.cut")) | F.coalesce(rank == F.col(f"{plan_name}.extra"), F.lit(False)))))
    copies = (F.col(f"{plan_name}.whole") + F.when(more, 1).otherwise(0)).cast("long")
    old = docs.drop("size", "source_size", "target", "copies", "taken").columns
    return met.select(
        *(f"`{c}`" for c in old),
        F.col(words).alias("size"),
        F.col(f"{plan_name}.source_size").alias("source_size"),
        F.col(f"{plan_name}.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col(words)).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay."""
    names = [f"`{c}`" for c in docs.columns]
    copies = mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")).where("copies > 0")
    return copies.select("row", F.explode(F.expr("array_repeat(0, int(copies))")).alias("_copy")).select("row.*").select(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in("text").alias("words"))
    return mix(durable(docs), size="words").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM w),
t AS (
  SELECT source, source_size, least(weight * max(share) OVER (), source_size * 3.0::DOUBLE) AS target
  FROM v),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS whole,
    CASE WHEN t.source_size > 0 THEN greatest(t.target / t.source_size - floor(t.target / t.source_size + 1e-12), 0) ELSE 0 END AS p
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT source, u, sum(size) AS size, min(target - whole * source_size) AS need, min(floor(u * ceil(n / {BIN_ROWS}.0))) AS bin
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM r) WHERE p > 0 GROUP BY source, u),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u) AS cum FROM g),
l AS (SELECT source, min(bin) AS last_bin FROM k WHERE cum >= need GROUP BY source),
m AS (
  SELECT k.*, last_bin, need - coalesce(max(CASE WHEN cum <= need THEN cum END) OVER (PARTITION BY k.source), 0) AS gap
  FROM k JOIN l ON k.source IS NOT DISTINCT FROM l.source),
x AS (
  SELECT source, min_by(u, (abs(size - gap), u)) AS extra FROM m WHERE bin = last_bin AND cum > need AND abs(size - gap) < gap GROUP BY source),
h AS (
  SELECT k.source, k.u, k.cum <= k.need OR l.last_bin IS NULL OR coalesce(k.u = x.extra, false) AS more
  FROM k LEFT JOIN l ON k.source IS NOT DISTINCT FROM l.source LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.whole + CASE WHEN coalesce(h.more, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN h ON r.source IS NOT DISTINCT FROM h.source AND r.u = h.u
"""
