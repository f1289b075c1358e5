"""A training-data pipeline over the documents table: five stages, each a table that the next one reads.

Cases, for all stages: an empty table gives an empty table; a null or empty text passes toxicity with the prior's score, equals other
empty texts in exact dedup, has no near copies, has no words and so no row in the mix. A null doc_id is kept by
toxicity and near-copy removal, and of equal texts stays only where no row with an id does. A null source is a source of its own. Rows that are
there twice end as one in exact dedup. Columns that the stages don't know go along up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common, exact_dedup, minhash, mixing, packing, toxicity
from docloom.llm.queries import tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores below one half."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more; the smallest doc_id of a group stays."""
    return minhash.drop_near_duplicates(docs, threshold=80, halves=16)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating, by code point; blocks of 128 words; a document comes up to three times, or in part."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens by best fit. The workers, which have served the stages before, remember fewer words."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), cache_bytes=CACHE_BYTES)


#: Bytes of the words that a worker remembers in packing.
CACHE_BYTES = 48 << 20

STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("minhash", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: Trained scores, pseudorandom draws and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.made()
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.clear(before)  # the stage before and what this one has written on its way
    return STAGES[-1][1](spark, docs, sf_dir)
