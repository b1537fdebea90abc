"""Descriptor chains, extensions, page deltas and range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def chain_segments(descriptors: DataFrame, per_segment: int = 16) -> DataFrame:
    """A root's ordered descriptors (digest, idx, chunk) cut into segments that name their parent."""
    n = F.floor(F.col("idx") / per_segment).cast("int")
    cut = descriptors.groupBy("digest", n.alias("n")).agg(F.array_sort(F.collect_list(F.struct("idx", "chunk"))).alias("d"))
    name = F.concat_ws("/", F.col("digest"), F.col("n"))
    return cut.select("digest", name.alias("segment"), F.when(F.col("n") > 0, F.concat_ws("/", F.col("digest"), F.col("n") - 1)).alias("parent"), (F.col("n") * per_segment).alias("first_index"), F.transform("d", lambda x: x["chunk"]).alias("chunks"))


def walk_chains(segments: DataFrame, tails: DataFrame) -> DataFrame:
    """Segments reached from each tail (root, segment) with their distance; ends at a missing parent or a cycle.

    All tails walk together by pointer doubling, so a chain takes rounds by the logarithm of its length. Round k adds what lies
    2 ** k steps behind what was reached; a segment that a tail has reached before isn't added, which ends cycles.
    """
    links = segments.select("segment", "parent").distinct()
    key = ["root", "tail", "segment"]
    reached = cut(tails.join(links.select("segment"), "segment", "left_semi").select("root", F.col("segment").alias("tail"), "segment", F.lit(0).alias("steps")).distinct())
    jumps = cut(links.join(links.select(F.col("segment").alias("parent")).distinct(), "parent", "left_semi").select("segment", F.col("parent").alias("to")))
    hops = 1
    while True:
        further = reached.join(jumps, "segment").select("root", "tail", F.col("to").alias("segment"), (F.col("steps") + hops).alias("steps"))
        new = cut(further.groupBy(key).agg(F.min("steps").alias("steps")).join(reached.select(key), key, "left_anti").select(*key, "steps"))
        if new.isEmpty():
            return reached.select("root", "segment", "steps")
        reached = reached.unionAll(new)
        jumps = cut(jumps.join(jumps.select(F.col("segment").alias("to"), F.col("to").alias("next")), "to").select("segment", F.col("next").alias("to")).distinct())
        hops *= 2


def extend(base: DataFrame, tail: DataFrame, chunk_tokens: int) -> DataFrame:
    """Complete chunks of the base, then the tail's; a partial last chunk of the base is replaced.

    Rows are (digest, start, end, chunk). An extension that isn't longer than its base gives no rows.
    """
    tokens = base.groupBy("digest").agg(F.max("end").alias("base_tokens"))
    whole = F.floor(F.col("base_tokens") / chunk_tokens) * chunk_tokens
    kept = base.join(tokens, "digest").where(F.col("end") <= whole).select("digest", "start", "end", "chunk", F.lit("base").alias("part"))
    added = tail.join(tokens, "digest").where(F.col("start") >= whole).select("digest", "start", "end", "chunk", F.lit("tail").alias("part"))
    longer = tail.groupBy("digest").agg(F.max("end").alias("new_tokens")).join(tokens, "digest").where("new_tokens > base_tokens").select("digest")
    return kept.unionAll(added).join(longer, "digest", "left_semi")


def overlay(stages: DataFrame) -> DataFrame:
    """Of each stage's pages [start, end) in a layer the part that no later stage replaces.

    A later stage replaces everything from its start on, so the cutoff is the least later start.
    """
    later = Window.partitionBy("root", "layer").orderBy("stage").rowsBetween(1, Window.unboundedFollowing)
    cutoff = F.least(F.col("end"), F.coalesce(F.min("start").over(later), F.col("end")))
    return stages.withColumn("live_end", cutoff).where("live_end > start").select("root", "layer", "stage", "start", "live_end")


def reusable_pages(base: DataFrame, result: DataFrame) -> DataFrame:
    """Longest common page prefix of each group across all its layers; rows (root, grp, layer, page, payload)."""
    key = ["root", "grp", "layer", "page"]
    both = base.withColumnRenamed("payload", "old").join(result.withColumnRenamed("payload", "new"), key, "full_outer")
    differ = F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("page"))
    return both.groupBy("root", "grp").agg(F.coalesce(F.min(differ), F.max("page") + 1).alias("reused"))


def apply_delta(base: DataFrame, tail: DataFrame, reused: DataFrame) -> DataFrame:
    """Base pages below the reused count and the tail's pages from there on."""
    left = base.join(reused, ["root", "grp"]).where("page < reused")
    right = tail.join(reused, ["root", "grp"]).where("page >= reused")
    return left.unionByName(right).drop("reused")


def read_ranges(extents: DataFrame, requests: DataFrame) -> DataFrame:
    """Pieces of a root's objects that overlap each requested range [lo, hi), with offsets inside the object."""
    overlap = (F.col("encoded_start") < F.col("hi")) & (F.col("encoded_end") > F.col("lo"))
    found = requests.join(extents, "digest").where(overlap)
    begin, end = F.greatest("lo", "encoded_start"), F.least("hi", "encoded_end")
    return found.select("request", "digest", "idx", (begin - F.col("encoded_start")).alias("offset"), (end - begin).alias("length"))


def first_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """First position at which two record streams (kind, pos, value) differ; null if they don't."""
    both = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), ["kind", "pos"], "full_outer")
    return both.groupBy("kind").agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos"))).alias("first_mismatch"), F.count("*").alias("compared"))
