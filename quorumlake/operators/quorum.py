"""Rank reports, all-rank quorum and longest stored prefixes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_quorum(held: DataFrame, ranks: int) -> DataFrame:
    """Digests that every rank in [0, ranks) holds. Ranks are a bitmap, so partial sums stay small."""
    have = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rank").cast("int"))).alias("have")
    return held.where(F.col("rank").between(0, ranks - 1)).groupBy("digest").agg(have).where(F.col("have") == (1 << ranks) - 1).select("digest")


def candidates_in_quorum(candidates: DataFrame, held: DataFrame, ranks: int) -> DataFrame:
    """Candidates (request, span, digest) whose digest has full quorum."""
    return candidates.join(full_quorum(held, ranks), "digest", "left_semi")


def longest_prefix(candidates: DataFrame, held: DataFrame, ranks: int) -> DataFrame:
    """The longest candidate of each request that has full quorum, in place of a reverse scan."""
    return candidates_in_quorum(candidates, held, ranks).groupBy("request").agg(F.max("span").alias("span"), F.max_by("digest", "span").alias("digest"))


def publication_base(candidates: DataFrame, held: DataFrame, ranks: int, spans: DataFrame) -> DataFrame:
    """The longest quorum prefix strictly shorter than the span to publish (request, publish_span)."""
    shorter = candidates.join(spans, "request").where("span < publish_span").drop("publish_span")
    return longest_prefix(shorter, held, ranks)


def prefix_digests(prompts: DataFrame, chunk_tokens: int, salt: bytes = b"s", align: int | None = None) -> DataFrame:
    """Request, span, digest at each multiple of ``chunk_tokens`` below the aligned span.

    Tokens are the code points of ``text``. The hash runs once over a prompt, its state copied at each
    boundary: work is linear in the prompt. At least one token is left to recompute.
    """
    step = align or chunk_tokens

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for request, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                last = (len(text) - 1) // step * step if text else 0
                state, spans, digests = hashlib.sha256(salt + b"\x00"), [], []
                for end in range(chunk_tokens, last + 1, chunk_tokens):
                    state.update(text[end - chunk_tokens : end].encode("utf-32-le"))
                    spans.append(end)
                    digests.append(state.copy().hexdigest())
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array([request] * len(spans), pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["request", "span", "digest"])

    return prompts.select(F.col("request").cast("long"), "text").mapInArrow(run, "request long, span long, digest string")


def held_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rank, digest, change) that turns the old report into the new: added and removed."""
    added = new.join(old, ["rank", "digest"], "left_anti").distinct().withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, ["rank", "digest"], "left_anti").distinct().withColumn("change", F.lit("removed")))


def apply_delta(held: DataFrame, delta: DataFrame) -> DataFrame:
    """(held - removed) + added."""
    kept = held.select("rank", "digest").join(delta.where("change = 'removed'"), ["rank", "digest"], "left_anti")
    return kept.unionByName(delta.where("change = 'added'").select("rank", "digest")).distinct()


def last_report(reports: DataFrame, order: str) -> DataFrame:
    """Of each rank's reports the last one."""
    return reports.groupBy("rank").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "rank"]), order).alias("r")).select("rank", "r.*")


def startup_batches(held: DataFrame, most: int = 512, page: int = 64) -> DataFrame:
    """The first ``most`` digests of each rank in pages."""
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("digest"))
    # the first of all are among the first of each part
    few = held.distinct().withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(1024))).withColumn("n", order("rank", "part")).where(F.col("n") <= most)
    numbered = few.withColumn("n", order("rank")).where(F.col("n") <= most)
    return numbered.select("rank", "digest", F.floor((F.col("n") - 1) / page).cast("long").alias("page"))


def flights(arrivals: DataFrame, followers: int = 16) -> DataFrame:
    """Role of each arrival for its digest: leader, follower, or overflow beyond the followers."""
    n = F.row_number().over(Window.partitionBy("digest").orderBy("arrival", "request"))
    role = F.when(F.col("n") == 1, "leader").when(F.col("n") <= followers + 1, "follower").otherwise("overflow")
    return arrivals.withColumn("n", n).select("request", "digest", role.alias("role"))


def flight_summary(roles: DataFrame) -> DataFrame:
    """Participants, physical reads and avoided reads of each flight."""
    joined = F.count_if(F.col("role") != "overflow")
    return roles.groupBy("digest").agg(joined.alias("participants"), F.count_if(F.col("role") != "follower").alias("physical_reads"), F.count_if(F.col("role") == "follower").alias("avoided_reads"))
