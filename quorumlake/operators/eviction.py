"""Time-to-live and least-recently-used eviction under byte watermarks, without a loop.

A chunk is freed when the last root that refers to it goes. So its freeing place is the
largest place of its roots in the order of removal, or never if a root that refers to it is
protected. A running sum of what each place frees gives the bytes before each removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import deal, parts
from .catalogue import expired, live_refs
from .ordering import ordered


def removal_order(roots: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """Place of each root that may go: invalid or expired ones first, then by recency and name."""
    phase = F.when(~F.col("valid") | expired(roots, now_ns, ttl_ns), 0).otherwise(1)
    open_ = roots.where(~(F.col("valid") & F.col("protected"))).withColumn("phase", phase)
    return ordered(open_, "phase", "mtime_ns", "digest")


def maintain(roots: DataFrame, refs: DataFrame, objects: DataFrame, *, now_ns: int, ttl_ns: int, max_bytes: int, low_bytes: int, budget: int | None = None) -> DataFrame:
    """(ord, digest, phase, freed, before, evicted) of each root that may go, in order.

    With a budget and any orphan to delete, no root is chosen in the pass; otherwise at most ``budget`` are.
    """
    order = removal_order(roots, now_ns, ttl_ns)
    live = live_refs(roots, refs)
    n = parts(refs)
    placed = live.join(deal(order.select("digest", "ord"), n, "digest"), "digest", "left")
    freeing = placed.groupBy("chunk").agg(F.max("ord").alias("ord"), F.bool_or(F.col("ord").isNull()).alias("kept"))
    chunk_bytes = freeing.where(~F.col("kept")).join(objects, "chunk").groupBy("ord").agg(F.sum("bytes").alias("chunk_bytes"))
    freed = deal(order, n, "ord").join(deal(chunk_bytes, n, "ord"), "ord", "left").withColumn("freed", F.col("manifest_bytes") + F.coalesce("chunk_bytes", F.lit(0)))
    totals = roots.agg(F.sum("manifest_bytes").alias("m")).crossJoin(objects.agg(F.sum("bytes").alias("o")))
    orphan = objects.join(live.select("chunk").distinct(), "chunk", "left_anti").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("orphan_bytes"), F.count("*").alias("n_orphans"))
    state = totals.crossJoin(orphan).select((F.coalesce("m", F.lit(0)) + F.coalesce("o", F.lit(0))).alias("bytes_before"), "orphan_bytes", "n_orphans")
    running = _running(freed)
    out = running.crossJoin(F.broadcast(state))  # one row
    before = F.col("bytes_before") - F.col("orphan_bytes") - F.col("gone_before")
    evict = (F.col("phase") == 0) | ((F.col("bytes_before") > max_bytes) & (before > low_bytes))
    if budget is not None:
        evict = evict & (F.col("n_orphans") == 0) & (F.col("ord") <= budget)
    return out.select("ord", "digest", "phase", "freed", before.alias("before"), evict.alias("evicted"))


def _running(freed: DataFrame, blocks: int = 50_000) -> DataFrame:
    """gone_before: bytes freed at smaller places. Blocks of places are summed first, so no task takes all rows; there are ``blocks`` of them at most."""
    block = max(100_000, -(-freed.count() // blocks))
    blocks = freed.withColumn("block__", F.floor(F.col("ord") / block))
    sums = blocks.groupBy("block__").agg(F.sum("freed").alias("s__"))
    before = sums.select("block__", F.coalesce(F.sum("s__").over(Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b__"))
    inside = F.coalesce(F.sum("freed").over(Window.partitionBy("block__").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("i__", inside).join(F.broadcast(before), "block__").withColumn("gone_before", F.col("i__") + F.col("b__")).drop("block__", "i__", "b__")


def report(decided: DataFrame) -> DataFrame:
    """One row of what a pass removes."""
    gone = F.col("evicted")
    return decided.agg(F.count("*").alias("candidates"), F.count_if(gone).alias("removed"), F.count_if(gone & (F.col("phase") == 0)).alias("removed_first"), F.coalesce(F.sum(F.when(gone, F.col("freed"))), F.lit(0)).alias("freed_bytes"))


def totals(decided: DataFrame, roots: DataFrame, refs: DataFrame, objects: DataFrame, max_bytes: int) -> DataFrame:
    """The pass's other measures: bytes before, reclaimed and after, orphans, whether the capacity is met, and the entries that survive."""
    gone = decided.where("evicted")
    left = roots.join(gone.select("digest"), "digest", "left_anti")
    orphan = objects.join(live_refs(roots, refs).select("chunk").distinct(), "chunk", "left_anti").agg(F.count("*").alias("orphan_chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("orphan_bytes"))
    before = roots.agg(F.coalesce(F.sum("manifest_bytes"), F.lit(0)).alias("m")).crossJoin(objects.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("o")))  # one row each
    freed = gone.agg(F.coalesce(F.sum("freed"), F.lit(0)).alias("freed"))
    x = before.crossJoin(orphan).crossJoin(freed).crossJoin(left.agg(F.count_if("valid").alias("surviving")))
    x = x.withColumn("bytes_before", F.col("m") + F.col("o")).withColumn("bytes_reclaimed", F.col("freed") + F.col("orphan_bytes"))
    after = F.col("bytes_before") - F.col("bytes_reclaimed")
    return x.select("bytes_before", "bytes_reclaimed", after.alias("bytes_after"), "orphan_chunks", (after <= max_bytes).alias("satisfied"), "surviving")
