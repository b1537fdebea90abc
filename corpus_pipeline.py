"""A corpus pipeline of five stages; each reads what the one before it wrote as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import bpe, decontaminate, linededup, simhash, toxicity
from quorumlake.llm.common import MADE, discard, free, shared_folder, table
from quorumlake.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. A null or empty text scores the bias alone; repeated rows are judged alike; no rows give none."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs go from the texts; a document goes only if deletions left no word of it.

    A null text stays null, an empty one stays; of repeated rows the first stays; n_chars is counted anew.
    """
    return linededup.drop_copies(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each component stays, of repeated rows the first, and rows without a doc_id. Empty and null texts are near each other."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; rows without a doc_id stay; rows of one doc_id go together."""
    name = free(docs.columns, "leaked__")
    leaked = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to; one row for each row, a null text has no ids."""
    import public_tokenizers

    done = bpe.encode_documents(docs, bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL can't express the classifier and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage read and wrote on its way is deleted when its result is stored."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        begun = len(MADE)
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path := shared_folder(spark))
        MADE.remove(path)
        MADE.extend(before)
        discard(spark, begun)
        docs, before = spark.read.parquet(path), [path]
    return docs
