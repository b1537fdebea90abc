"""Roots, references and objects: counts, orphans, shadowing, validity, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import deal, parts


def live_refs(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (digest, chunk) of valid roots: a chunk listed twice by a root counts once, an invalid root has none."""
    n = parts(refs)
    # no semi-join: the optimizer would move it below the repartition, and the rows would be shuffled twice
    return deal(refs.select("digest", "chunk"), n, "digest").join(deal(roots.where("valid").select("digest"), n, "digest").distinct(), "digest").distinct()


def reference_counts(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """Roots that refer to each chunk."""
    return live_refs(roots, refs).groupBy("chunk").agg(F.count("*").alias("refcount"))


def store_bytes(roots: DataFrame, objects: DataFrame, block: int = 4096) -> DataFrame:
    """Logical bytes of manifests and objects, and their bound in whole blocks."""
    sizes = roots.select(F.col("manifest_bytes").alias("b")).unionAll(objects.select(F.col("bytes").alias("b")))
    return sizes.agg(F.count("*").alias("files"), F.sum("b").alias("logical_bytes"), F.sum(F.ceil(F.col("b") / block) * block).alias("allocated_bytes"))


def orphans(roots: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that no valid root refers to."""
    n = parts(refs)
    return objects.join(deal(live_refs(roots, refs).select("chunk"), n, "chunk"), "chunk", "left_anti")


def unshadowed(aliases: DataFrame, roots: DataFrame) -> DataFrame:
    """Aliases whose key has no exact root, valid or not."""
    return aliases.join(roots.select("storage_key", "digest"), ["storage_key", "digest"], "left_anti")


def survivors(roots: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Valid roots all of whose references exist as objects."""
    missing = live_refs(roots, refs).join(objects, "chunk", "left_anti").select("digest").distinct()
    return roots.where("valid").join(missing, "digest", "left_anti").select("storage_key", "digest")


def evictable(roots: DataFrame) -> DataFrame:
    """What may be removed: all but roots that are both valid and protected."""
    return roots.where(~(F.col("valid") & F.col("protected")))


def discover(roots: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each namespace how many entries were checked, offered and rejected."""
    entries = roots.select("storage_key", "valid").unionAll(unshadowed(aliases, roots).select("storage_key", "valid"))
    return entries.groupBy("storage_key").agg(F.count("*").alias("checked"), F.count_if("valid").alias("offered"), F.count_if(~F.col("valid")).alias("rejected"))


def lookup(requests: DataFrame, roots: DataFrame, aliases: DataFrame) -> DataFrame:
    """(is_hit, reason, root_kind) of each (storage_key, digest); an exact root shadows an alias even when corrupt."""
    key = ["storage_key", "digest"]
    exact = roots.select(*key, F.col("valid").alias("exact"))
    alias = aliases.select(*key, F.col("valid").alias("alias"))
    found = requests.join(exact, key, "left").join(alias, key, "left")
    chosen = F.coalesce("exact", "alias")
    reason = F.when(chosen.isNull(), "absent").when(chosen, "hit").otherwise("corrupt")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").otherwise("none")
    return found.select(*requests.columns, F.coalesce(chosen, F.lit(False)).alias("is_hit"), reason.alias("reason"), kind.alias("root_kind"))


def contiguous(spans: DataFrame, root: str = "digest", order: str = "idx") -> DataFrame:
    """Whether each root's spans (start, end) follow on from 0 without a gap, and their total."""
    over = Window.partitionBy(root).orderBy(order)
    checked = spans.withColumn("ok", (F.lag("end", 1, 0).over(over) == F.col("start")) & (F.col("end") > F.col("start")))
    return checked.groupBy(root).agg(F.bool_and("ok").alias("contiguous"), F.max("end").alias("tokens"), F.count("*").alias("chunks"))


def extent_offsets(refs: DataFrame, root: str = "digest", order: str = "idx") -> DataFrame:
    """Where each object begins and ends in its root's concatenation."""
    over = Window.partitionBy(root).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("bytes").over(over)
    return deal(refs, parts(refs), root).withColumn("encoded_end", end).withColumn("encoded_start", F.col("encoded_end") - F.col("bytes"))


def publish(objects: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each distinct incoming (chunk, bytes): published, duplicate, or conflict of sizes for a key."""
    offered = incoming.distinct()
    sizes = offered.groupBy("chunk").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"))
    outcome = F.when(F.col("n") > 1, "conflict").when(F.col("stored").isNull(), "published").when(F.col("stored") == F.col("bytes"), "duplicate").otherwise("conflict")
    return sizes.join(objects.select("chunk", F.col("bytes").alias("stored")), "chunk", "left").select("chunk", "bytes", outcome.alias("outcome"))


def touched(roots: DataFrame, now_ns: Column, least_seconds: int = 60) -> DataFrame:
    """Recency after a touch; skipped where the last one is less than the interval ago."""
    due = now_ns - F.col("mtime_ns") >= least_seconds * 1_000_000_000
    return roots.select("storage_key", "digest", F.when(due, now_ns).otherwise(F.col("mtime_ns")).alias("mtime_ns"), due.alias("touched"))


def expired(roots: DataFrame, now_ns: int, ttl_ns: int) -> Column:
    """Age at or beyond the time to live; zero or less never expires; an unknown root counts as expired."""
    if ttl_ns <= 0:
        return F.lit(False)
    return F.coalesce(F.lit(now_ns) - F.col("mtime_ns") >= ttl_ns, F.lit(True))


def invalidate(roots: DataFrame, damaged: DataFrame) -> DataFrame:
    """The roots without the damaged ones, matched by key and kind."""
    return roots.join(damaged, damaged.columns, "left_anti")


def alias_boundaries(contexts: DataFrame, chunk_tokens: int = 256, every: int = 16, most: int = 64) -> DataFrame:
    """Boundaries of a context (digest, tokens) at every 16 chunks, the last 64 of them."""
    stride = chunk_tokens * every
    n = F.floor((F.col("tokens") - 1) / stride).cast("long")
    steps = F.when(n >= 1, F.sequence(F.greatest(n - most + 1, F.lit(1)), n)).otherwise(F.array().cast("array<bigint>"))
    return contexts.select("digest", F.explode(steps).alias("k")).select("digest", (F.col("k") * stride).alias("boundary"), (F.col("k") * every).alias("chunk_count"))


def inventory(files: DataFrame) -> DataFrame:
    """Kind of each stored file (path, bytes) by its folder and name: root, alias, segment, chunk, or debris that a stopped writer left."""
    name = lambda folder, suffix: F.col("path").rlike(rf"(^|/){folder}/[^/]*\.{suffix}$")
    kind = F.when(F.col("path").rlike(r"\.tmp$"), "debris").when(name("roots/[^/]+", "json"), "root").when(name("aliases/[^/]+", "json"), "alias").when(name("segments", "json"), "segment").when(name("chunks", "chunk"), "chunk").otherwise("debris")
    return files.withColumn("kind", kind)


def inventory_totals(files: DataFrame) -> DataFrame:
    """Files and bytes of each kind."""
    return inventory(files).groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
