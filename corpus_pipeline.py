"""A training corpus in stages, each over all that the stage before kept.

A stage takes (spark, docs, sf_dir); its result is written and read again as the
next one's documents. All but the last return the columns of documents, extra ones too.

Null and empty texts are clean, are like nothing, add no words to a mix (so they
may be in it up to three times) and pack as their end id. Null ids take part. Rows that repeat are
one after near duplicates, and texts that differ stay even if they repeat an id. Ties go by id, then by the
text's hash. Whole texts count, however long. No documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import mixing, neardup, packing, toxicity
from tallyflow.llm.queries import in_five, table, vocabulary
from tallyflow.session import settle, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable=in_five() != 0)
    rows = docs.select(F.struct("*").alias("row"), toxicity.score(F.col("text"), model).alias("score"))
    return rows.filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words stay."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    small_batches(spark)
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their ids."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
