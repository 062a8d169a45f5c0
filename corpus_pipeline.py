"""Corpus pipeline: toxicity, exact copies, near copies, benchmark passages, then SentencePiece encoding.

Each stage takes all its predecessor kept; its result is written to the shared folder and read back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontaminate, exact_dedup, jaccard_join, sentence_pieces, toxicity
from tidewatch.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the classifier learns from the labelled rows of ``documents``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), use=~toxicity.held_out())
    return toxicity.drop_toxic(docs, model, 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (Jaccard of 0.75 or more, directly or in a chain) the smallest id stays."""
    return jaccard_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have a twentieth or more of their words in benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left; decoding them gives the text again."""
    vocabulary = sentence_pieces.public_vocabulary()
    coded = sentence_pieces.decode(sentence_pieces.encode(docs.drop("ids", "decoded"), vocabulary), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("decontamination", drop_contaminated), ("sentence_pieces", encode)]

#: The learnt classifier and the piece walk have no SQL form; tests compare run() with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
