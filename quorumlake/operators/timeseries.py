"""Write budgets, device counters, latencies, stage timings, heat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordering import in_group

HOUR_NS = 3_600_000_000_000


def write_windows(writes: DataFrame, window_ns: int = HOUR_NS, limit: int | None = None) -> DataFrame:
    """Bytes in each tumbling window and whether they exceed the limit; without one that is null."""
    start = F.floor(F.col("at_ns") / window_ns).cast("long") * window_ns
    sums = writes.groupBy(start.alias("window_ns")).agg(F.count("*").alias("events"), F.sum("unique").alias("unique_bytes"), F.sum("staged").alias("staged_bytes"))
    most = F.lit(limit).cast("long")
    return sums.withColumn("exceeded", F.col("staged_bytes") > most).withColumn("over_bytes", F.when(most.isNotNull(), F.greatest(F.col("staged_bytes") - most, F.lit(0))))


def invalid_writes(writes: DataFrame, kinds: list[str]) -> DataFrame:
    """Events that break a rule: unknown kind, negative or more unique than staged bytes, or a time before that of the event before."""
    late = F.lag("at_ns").over(Window.partitionBy("key").orderBy("event_id")) > F.col("at_ns")
    reason = F.array_compact(F.array(F.when(~F.col("kind").isin(kinds), F.lit("kind")), F.when(F.col("unique") < 0, F.lit("negative")), F.when(F.col("unique") > F.col("staged"), F.lit("unique_over_staged")), F.when(late, F.lit("late"))))
    return writes.withColumn("reasons", reason).where(F.size("reasons") > 0).select("event_id", F.array_join("reasons", ",").alias("reasons"))


def counter_deltas(samples: DataFrame, unit: int = 512_000) -> DataFrame:
    """Bytes and rate between samples of a device; null and a reason where time or units don't advance."""
    over = Window.partitionBy("device").orderBy("at_ns", "sample_id")
    units, time = F.col("units") - F.lag("units").over(over), F.col("at_ns") - F.lag("at_ns").over(over)
    out = samples.withColumn("d_units", units).withColumn("d_ns", time).where("d_units is not null")
    reason = F.when(F.col("d_units") < 0, "decreasing").when((F.col("d_ns") == 0) & (F.col("d_units") != 0), "same_time").otherwise("ok")
    good = reason == "ok"
    return out.select("device", "sample_id", F.when(good, F.col("d_units") * unit).alias("bytes"), F.when(good, F.floor(F.try_divide(F.col("d_units") * unit * 1000, F.floor(F.col("d_ns") / 1_000_000)))).cast("long").alias("bytes_a_second"), reason.alias("reason"))


def latency_summary(requests: DataFrame, *groups: str) -> DataFrame:
    """Count, successes, failures, and nearest-rank percentiles of the successes.

    The percentiles are read at their places in a range sort, so that a group of any size is never in one task.
    """
    if not groups:
        return latency_summary(requests.withColumn("all__", F.lit(0)), "all__").drop("all__")
    ok = F.when(F.col("ok"), F.col("elapsed"))
    counts = requests.groupBy(*groups).agg(F.count("*").alias("requests"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.min(ok).alias("min"), F.max(ok).alias("max"))
    counts = cut(counts)
    placed = in_group(requests.where("ok").select(*groups, "elapsed"), list(groups), "elapsed").join(counts.select(*groups, "succeeded"), list(groups))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p).cast("decimal(4,2)") * F.col("succeeded")))
    read = placed.where((F.col("n") == at("0.5")) | (F.col("n") == at("0.95"))).groupBy(*groups).agg(F.max(F.when(F.col("n") == at("0.5"), F.col("elapsed"))).alias("p50"), F.max(F.when(F.col("n") == at("0.95"), F.col("elapsed"))).alias("p95"))
    return counts.join(read, list(groups), "left").select(*groups, "requests", "succeeded", "failed", "min", "p50", "p95", "max")


def stage_timings(marks: DataFrame) -> DataFrame:
    """Nanoseconds from the first stage to each; the first mark of a stage counts, and times never fall back."""
    first = marks.groupBy("request", "stage").agg(F.min("at_ns").alias("at_ns"))
    over = Window.partitionBy("request").orderBy("stage")
    raised = F.max("at_ns").over(over.rowsBetween(Window.unboundedPreceding, 0))
    return first.select("request", "stage", (raised - F.first("at_ns").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("since_first_ns"))


def heat(trace: DataFrame, window: int = 8192, cap: int = 255, shift: int = 1) -> DataFrame:
    """Saturating hit counters by key, halved after every ``window`` hits.

    The hit's number gives its epoch. Each key's hits by epoch are folded: between epochs the
    counter is shifted once for each that passed, within one it only adds and saturates.
    """
    epochs = trace.withColumn("epoch", F.floor((F.col("n") - 1) / window).cast("long")).groupBy("key", "epoch").agg(F.count("*").alias("hits"))
    last = trace.agg(F.floor(F.max("n") / window).cast("long").alias("now"))
    folded = epochs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("epoch", "hits"))).alias("e")).crossJoin(F.broadcast(last))  # one row
    zero = F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("c"))
    decay = lambda c, gap: F.floor(c / F.pow(F.lit(2.0), F.least(F.lit(62), shift * gap))).cast("long")
    step = lambda a, x: F.struct(x["epoch"].alias("epoch"), F.least(F.lit(cap).cast("long"), decay(a["c"], x["epoch"] - a["epoch"]) + x["hits"]).alias("c"))
    end = F.aggregate("e", zero, step)
    return folded.select("key", decay(end["c"], F.col("now") - end["epoch"]).alias("heat"))
