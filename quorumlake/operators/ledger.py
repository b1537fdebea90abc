"""Byte accounting: what contexts share, publication receipts, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import deal, parts
from .catalogue import live_refs, reference_counts


def shared_bytes(roots: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Chunks and bytes that each valid root shares with others, and what removing it alone would free."""
    counts = reference_counts(roots, refs)
    n = parts(refs)
    rows = deal(live_refs(roots, refs), n, "chunk").join(deal(counts, n, "chunk"), "chunk").join(deal(objects, n, "chunk"), "chunk")
    shared = F.col("refcount") > 1
    per = deal(rows, n, "digest").groupBy("digest").agg(F.count("*").alias("chunks"), F.count_if(shared).alias("shared_chunks"), F.sum(F.when(shared, F.col("bytes")).otherwise(0)).alias("shared_bytes"), F.sum(F.when(shared, 0).otherwise(F.col("bytes"))).alias("own_bytes"))
    own = F.col("own_bytes") + F.col("manifest_bytes")
    return per.join(roots.select("digest", "manifest_bytes"), "digest").select("digest", "chunks", "shared_chunks", "shared_bytes", own.alias("marginal_bytes"), (own + F.col("shared_bytes")).alias("encoded_bytes"))


def recomputation_avoided(committed: Column, computed: Column) -> Column:
    """Tokens that need no recomputation; null if more are computed than committed."""
    return F.when(computed <= committed, committed - computed)


def receipt(attempts: DataFrame) -> DataFrame:
    """Logical and reused bytes count only where the attempt committed."""
    done = F.col("outcome") == "committed"
    return attempts.withColumn("logical_bytes", F.when(done, F.col("payload_bytes")).otherwise(0)).withColumn("reused_bytes", F.when(done, F.greatest(F.col("payload_bytes") - F.col("unique_bytes"), F.lit(0))).otherwise(0))


def receipt_totals(receipts: DataFrame) -> DataFrame:
    """Attempts and bytes by outcome."""
    return receipts.groupBy("outcome").agg(F.count("*").alias("attempts"), *(F.sum(c).alias(c) for c in ("logical_bytes", "reused_bytes", "unique_bytes", "staged_bytes")))


def write_amplification(totals: DataFrame) -> DataFrame:
    """Ratios by key in thousandths; a zero or null denominator gives null."""
    ratio = lambda a, b: F.floor(F.try_divide(F.col(a) * 1000, F.col(b))).cast("long")
    return totals.withColumn("staged_per_unique", ratio("staged", "unique")).withColumn("unique_per_staged", ratio("unique", "staged"))


def rank_statistics(stats: DataFrame) -> DataFrame:
    """One row over all ranks' reports: sums, maxima, agreement, and alerts that aren't zero."""
    return stats.agg(F.count("*").alias("ranks"), F.sum("entries").alias("entries"), F.max("bytes").alias("most_bytes"), F.bool_and("healthy").alias("healthy"), F.when(F.sum("alerts") > 0, F.sum("alerts")).alias("alerts"))


def reduce_ranks(stats: DataFrame, sums: list[str], maxima: list[str], flags: list[str], alerts: list[str], sizes: list[str] = ()) -> DataFrame:
    """One row over all ranks' reports: sums, maxima, whether all ranks agree to a flag, how many raise an alert (null for none), and sizes in GiB with one digit."""
    return stats.agg(
        F.count("*").alias("ranks"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(f"most_{c}") for c in maxima), *(F.bool_and(c).alias(f"all_{c}") for c in flags),
        *(F.when(F.count_if(F.col(c) > 0) > 0, F.count_if(F.col(c) > 0)).alias(f"ranks_{c}") for c in alerts), *(F.bround(F.sum(c) / float(1 << 30), 1).alias(f"{c}_gib") for c in sizes),
    )
