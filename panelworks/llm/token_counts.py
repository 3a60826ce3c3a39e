"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are encoded once and only their lengths are kept: a groupBy with map-side combine gives
(length, documents). All later answers come from that histogram, whose row count is the number of
distinct lengths. Suffix and prefix sums run in two levels (inside blocks of lengths, then over block
totals), so no task sorts all lengths.

Null and empty texts have length 0. Repeated rows count each. An empty table gives an empty histogram.
Only the text column is read, so nulls or clashing names in other columns do not matter.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import durable, slices, table, texts

BLOCK = 1024
_ENCODERS: dict = {}


def _encoder(path: str, pattern: str):
    """A byte-level BPE encoder, one per Python worker and vocabulary."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encoded_lengths(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` per row of docs: the length of its encoded text."""

    def run(batches):
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) for t in texts(batch)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Answers for each occurring length taken as a context limit.

    ``docs`` and ``tokens`` at exactly this length; ``docs_longer`` and ``tokens_longer`` beyond it;
    ``docs_within`` and ``tokens_within`` up to it; ``truncated_tokens``: tokens left when every document
    is cut at this length; ``quantile``: the share of documents that fit whole.
    """
    hist = durable(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    hist = hist.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    inner = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("*", F.sum("docs").over(inner).alias("d"), F.sum("tokens").over(inner).alias("t"))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per 1,024 lengths
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bd", "bt")),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("bd", "bt")),
    )
    at = hist.join(blocks, "block")
    within, inside = F.col("d") + F.col("bd_before"), F.col("t") + F.col("bt_before")
    return at.select(
        "n_tokens",
        "docs",
        "tokens",
        within.alias("docs_within"),
        inside.alias("tokens_within"),
        (F.col("bd_all") - within).alias("docs_longer"),
        (F.col("bt_all") - inside).alias("tokens_longer"),
        (inside + F.col("n_tokens") * (F.col("bd_all") - within)).alias("truncated_tokens"),
        (within / F.col("bd_all")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents, tokens and truncated totals for arbitrary context limits, from the histogram alone."""
    grid = histogram.sparkSession.createDataFrame([(x,) for x in limits], "context long")
    hist = histogram.select("n_tokens", "docs", "tokens")
    fits = F.col("n_tokens") <= F.col("context")
    return (
        hist.select("*", F.explode(F.array(*map(F.lit, limits))).cast("long").alias("context"))
        .groupBy("context")
        .agg(
            F.sum(F.when(fits, F.col("docs")).otherwise(0)).alias("docs_within"),
            F.sum("docs").alias("docs"),
            F.sum(F.when(fits, F.col("tokens")).otherwise(F.col("docs") * F.col("context"))).alias("truncated_tokens"),
        )
        .join(grid, "context", "right")
        .na.fill(0)
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents"), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN))
