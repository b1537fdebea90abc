"""Pages, slots and shards: integer arithmetic over spans."""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned_positions(span: Column, degree: int, rank: Column) -> Column:
    """Positions of a span that a shard owns, none where the rank lies beyond the span."""
    none = F.array().cast("array<bigint>")
    return F.when(rank < span, F.sequence(rank.cast("long"), span.cast("long") - 1, F.lit(degree).cast("long"))).otherwise(none)


def slots(positions: Column, block_ids: Column, block_size: int, degree: int) -> Column:
    """Physical slot of each owned position."""
    return F.transform(positions, lambda p: F.get(block_ids, F.floor(F.floor(p / degree) / block_size).cast("int")) * block_size + F.floor(p / degree) % block_size)


def aligned_span(length: Column, quanta: list[int]) -> Column:
    """The longest multiple of all quanta that leaves one token to recompute."""
    step = reduce(lcm, quanta, 1)
    return F.when(length > 0, F.floor((length - 1) / step) * step).otherwise(0).cast("long")


def layer_kind(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose text the lower-case name contains."""
    out = None
    for part, kind in rules:
        hit = F.lower(name).contains(part)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def missing_kinds(layers: DataFrame, required: list[str]) -> DataFrame:
    """Required kinds that a layout's layers lack."""
    need = F.array(*map(F.lit, required))
    return layers.groupBy("layout").agg(F.array_join(F.array_sort(F.array_except(need, F.collect_set("kind"))), ",").alias("missing"))


def page_window(span: Column, policy: Column, block: Column, window: Column) -> Column:
    """(first, count) of the blocks that a group keeps for a span: all, a sliding window's, or the last one."""
    n = F.ceil(span / block)
    first = F.when(policy == "sliding", F.greatest(F.floor((span - window) / block), F.lit(0))).when(policy == "recurrent", F.greatest(n - 1, F.lit(0))).otherwise(0)
    return F.struct(first.cast("long").alias("first"), (n - first).cast("long").alias("count"))


def extension_pages(base: Column, span: Column, block: Column) -> Column:
    """Pages to capture again when a base grows to a span: from the base's last whole page on."""
    first = F.floor(base / block)
    return F.struct(first.cast("long").alias("first"), (F.ceil(span / block) - first).cast("long").alias("count"))


def snapshot_size(layers: DataFrame) -> DataFrame:
    """Encoded bytes of a layout's pages (page_count, bytes_per_page by layer)."""
    return layers.groupBy("layout").agg(F.sum(F.col("page_count") * F.col("bytes_per_page")).alias("encoded_bytes"), F.count("*").alias("layers"))


def aligned_offsets(kinds: DataFrame, align: int = 256) -> DataFrame:
    """Offset of each record kind when each begins at a multiple of ``align``; kinds are folded in order."""
    up = lambda x: F.floor((x + align - 1) / align).cast("long") * align
    rows = kinds.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "bytes"))).alias("k"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<kind:string,offset:bigint>>").alias("out"))
    step = lambda a, x: F.struct((up(a["end"]) + x["bytes"]).alias("end"), F.concat(a["out"], F.array(F.struct(x["kind"].alias("kind"), up(a["end"]).alias("offset")))).alias("out"))
    return rows.select("layout", F.explode(F.aggregate("k", zero, step)["out"]).alias("o")).select("layout", "o.kind", "o.offset")


def split_extents(snapshots: DataFrame, extent: int) -> DataFrame:
    """A snapshot's bytes cut into extents of at most ``extent``."""
    n = F.ceil(F.col("bytes") / extent)
    cuts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return snapshots.select("digest", "bytes", F.explode(cuts).alias("idx")).select("digest", "idx", (F.col("idx") * extent).alias("begin"), F.least((F.col("idx") + 1) * extent, F.col("bytes")).alias("end"))


def chunk_spans(contexts: DataFrame, chunk_tokens: int) -> DataFrame:
    """The chunks [start, end) of each context (digest, tokens); all but the last are full."""
    n = F.ceil(F.col("tokens") / chunk_tokens)
    cuts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return contexts.select("digest", "tokens", F.explode(cuts).alias("idx")).select("digest", "idx", (F.col("idx") * chunk_tokens).alias("start"), F.least((F.col("idx") + 1) * chunk_tokens, F.col("tokens")).alias("end"))


def range_blocks(block_ids: Column, start: Column, end: Column, width: int) -> Column:
    """Blocks of a request's table that a token range touches."""
    first = F.floor(start / width).cast("int")
    return F.slice(block_ids, first + 1, F.ceil(end / width).cast("int") - first)
