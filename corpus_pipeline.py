"""Documents to packed training sequences in five stages, each written and read again as Parquet.

Null and empty texts go with the language stage, since no language is recognised in them. Of repeated rows (doc_id and text) one
stays; rows of one doc_id with different texts are one document to the near-duplicate stage. Rows without doc_id stay, and are
compared with no other. Columns beyond those of documents are carried up to the last stage. An empty table gives no sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import language, mixing, packing, passages, simhash
from panelworks.llm.common import remove_folder, shared_folder, shuffles_removed, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.known_language(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash fingerprints of five-word shingles, min-hashes for what they miss, similarity 0.8."""
    return simhash.keep_first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return passages.without_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    import public_tokenizers as public

    return packing.pack_documents(docs, str(public.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_sources),
    ("packing", pack),
]
ORACLE_SQL = None  # a tokenizer, min-hashes and string kernels are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # its last reader is done
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
