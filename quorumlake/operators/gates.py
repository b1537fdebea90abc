"""Rule tables: every check is a row's reason, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """P20: names of the rules that a row breaks, in the table's order, comma-joined; a null rule isn't broken."""
    return F.array_join(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))), ",")


def disjoint_ranges(features: DataFrame, length: str = "tokens") -> DataFrame:
    """Whether a request's (offset, size) features are ordered, disjoint and inside its tokens."""
    over = Window.partitionBy("request").orderBy("ordinal")
    ok = (F.lag(F.col("offset") + F.col("size"), 1, 0).over(over) <= F.col("offset")) & (F.col("size") > 0) & (F.col("offset") + F.col("size") <= F.col(length))
    return features.withColumn("ok", ok).groupBy("request").agg(F.bool_and("ok").alias("valid"), F.count("*").alias("features"))


def valid_digest(value: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def scope_binding(scope: Column, digest: Column) -> Column:
    """Digest bound to a request's scope."""
    return F.sha2(F.concat(scope, F.lit(":"), digest).cast("binary"), 256)


def common_values(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Whether each column has one value within a group."""
    return rows.groupBy(*by).agg(*(F.expr(f"count(distinct {n}) = 1 and count({n}) = count(*)").alias(f"{n}_common") for n in names))


def completeness(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys that are missing, extra or repeated."""
    key = expected.columns
    seen = observed.groupBy(*key).agg(F.count("*").alias("n"))
    both = seen.join(expected.withColumn("want", F.lit(1)), key, "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.withColumn("state", state).where("state is not null").select(*key, "state")


def idle(metrics: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Whether all the named metrics, summed over their labels, are zero; null if one is absent."""
    sums = metrics.where(F.col("name").isin(names)).groupBy(*by, "name").agg(F.sum("value").alias("value"))
    return sums.groupBy(*by).agg(F.when(F.count("*") == len(names), F.bool_and(F.col("value") == 0)).alias("idle"))


def matrix_decision(cells: DataFrame) -> DataFrame:
    """From (mode, depth, block_rate, p95): whether depth 3 is useful, and which mode wins.

    Depth 3 is useful if depth 2 blocks more than half a percent and depth 3 halves that; the managed mode wins at 0.9 of the p95 or less.
    """
    at = lambda mode, depth, column: F.max(F.when((F.col("mode") == mode) & (F.col("depth") == depth), F.col(column)))
    wide = cells.agg(*(at(m, k, c).alias(f"{m}_{k}_{c}") for m in ("managed", "pinned") for k in (2, 3) for c in ("block_rate", "p95")))
    useful = lambda m: (F.col(f"{m}_2_block_rate") > 0.005) & (F.col(f"{m}_3_block_rate") <= F.col(f"{m}_2_block_rate") / 2)
    depth = lambda m: F.when(useful(m), 3).otherwise(2)
    p95 = lambda m: F.when(useful(m), F.col(f"{m}_3_p95")).otherwise(F.col(f"{m}_2_p95"))
    return wide.select(depth("managed").alias("managed_depth"), depth("pinned").alias("pinned_depth"), F.when(p95("managed") <= 0.9 * p95("pinned"), "managed").otherwise("pinned").alias("winner"))


def probe_cells(records: DataFrame) -> DataFrame:
    """Probe records summed to cells of mode and depth: totals, maxima, and whether all four ranks are there once."""
    return records.groupBy("mode", "depth").agg(F.count("*").alias("records"), F.sum("blocks").alias("blocks"), F.max("p95").alias("p95"), ((F.count_distinct("rank") == 4) & (F.count("*") == 4)).alias("complete"))


def group_topology(groups: DataFrame) -> DataFrame:
    """Digest of a layout's groups in order, and whether each group has one policy."""
    per = groups.groupBy("layout", "grp").agg(F.count_distinct("policy").alias("policies"), F.min("policy").alias("policy"), F.count("*").alias("layers"))
    listed = F.array_sort(F.collect_list(F.struct("grp", "layers", "policy")))
    return per.groupBy("layout").agg(F.sha2(F.to_json(listed).cast("binary"), 256).alias("topology"), F.bool_and(F.col("policies") == 1).alias("uniform"))


def resolve_alias(name: Column, aliases: dict[str, str]) -> Column:
    """The profile that a name stands for, else the name."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[name], name)
