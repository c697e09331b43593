"""Run logs: per-case summaries, memory-time, step and epoch histories, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.prefix import with_carries, with_rank
from voxtally.operators.overlap import cohort_score

#: Emitted rows of an epoch over which one window runs.
STRETCH = 4096


def run_summary(log: DataFrame) -> DataFrame:
    """One row over a run's case rows.

    Every status but ``ok`` counts as failed, timeouts included. Missing seconds and memory enter sums and means as 0. The
    cohort score uses only rows with metrics.
    """
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("total_seconds", "rss_mb", "cpu_memory_time_mb_seconds")}
    seconds, rss, memory = zero.values()
    totals = log.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.col("status") != "ok").alias("failed_case_count"),
        F.count_if(F.col("status") == "timeout").alias("timeout_case_count"),
        F.coalesce(F.max(seconds), F.lit(0.0)).alias("max_total_seconds"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_total_seconds"),
        F.coalesce(F.max(rss), F.lit(0.0)).alias("max_rss_mb"),
        F.coalesce(F.sum(memory), F.lit(0.0)).alias("total_cpu_memory_time_mb_seconds"),
        F.coalesce(F.avg(memory), F.lit(0.0)).alias("mean_cpu_memory_time_mb_seconds"),
    )
    return totals.crossJoin(F.broadcast(cohort_score(log)))


def memory_time(samples: DataFrame, key: str, bucket_seconds: int = 3600) -> DataFrame:
    """Trapezoid integral of ``value`` over ``ts`` per key, with its peak.

    Steps are taken inside time buckets, so a key with very many samples is ordered in pieces; each bucket's last sample
    is joined to the next bucket through one row per bucket. Fewer than two samples integrate to 0.
    """
    seconds = F.col("ts").cast("timestamp").cast("double")
    timed = samples.select(key, seconds.alias("t"), "value").withColumn("bucket", F.floor(F.col("t") / bucket_seconds))
    order = Window.partitionBy(key, "bucket").orderBy("t", "value")
    steps = timed.withColumn("pt", F.lag("t").over(order)).withColumn("pv", F.lag("value").over(order))
    area = F.greatest(F.col("t") - F.col("pt"), F.lit(0.0)) * 0.5 * (F.col("value") + F.col("pv"))
    point = F.struct("t", "value")
    buckets = steps.groupBy(key, "bucket").agg(
        F.sum(area).alias("area"), F.max("value").alias("peak"), F.min(point).alias("first"), F.max(point).alias("last")
    )
    before = F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))
    gap = F.greatest(F.col("first.t") - F.col("before.t"), F.lit(0.0)) * 0.5 * (F.col("first.value") + F.col("before.value"))
    return buckets.withColumn("before", before).groupBy(key).agg(
        (F.coalesce(F.sum("area"), F.lit(0.0)) + F.coalesce(F.sum(gap), F.lit(0.0))).alias("memory_time_mb_seconds"),
        F.max("peak").alias("sample_peak_rss_mb"),
    )


def numeric_means(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column, over all rows or by group."""
    by = by or []
    kinds = ("int", "bigint", "float", "double", "smallint", "tinyint")
    numbers = [f.name for f in rows.schema.fields if f.name not in by and (f.dataType.simpleString() in kinds or f.dataType.simpleString().startswith("decimal"))]
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers])


def epoch_rollup(steps: DataFrame, measures: list[str]) -> DataFrame:
    return steps.groupBy("epoch").agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("steps"))


def number_steps(steps: DataFrame) -> DataFrame:
    """``step`` from 1 within each epoch, by ``ts`` and ``step_key``."""
    return with_rank(steps, ["epoch"], ["ts", "step_key"], "step").withColumn("step", F.col("step").cast("int"))


def running_means(steps: DataFrame, measures: list[str], every: int = 10) -> DataFrame:
    """Running means within an epoch after every ``every`` steps and after the last.

    Steps are first summed in blocks that end where a row is emitted, and blocks in stretches of ``STRETCH``: a window runs inside a stretch,
    another over the stretches of an epoch.
    """
    size = max(int(every), 1)
    blocks = steps.withColumn("block", F.floor((F.col("step") - 1) / size)).groupBy("epoch", "block").agg(
        F.max("step").alias("step"), F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    ).withColumn("stretch", F.floor(F.col("block") / STRETCH))
    carried = with_carries(blocks, ["epoch"], "stretch", {f"{c}_before": F.sum(c) for c in ("n", *measures)})
    upto = Window.partitionBy("epoch", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)

    def total(c: str) -> Column:
        own, before = F.sum(c).over(upto), F.col(f"{c}_before")
        return F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0)))

    return carried.select("epoch", "step", *[(total(m) / total("n")).alias(f"{m}_running") for m in measures])


def step_pace(steps: DataFrame, every: int = 10) -> DataFrame:
    """Elapsed seconds since the epoch's first step, steps per second and the estimated rest, at the emitted steps."""
    bounds = steps.groupBy("epoch").agg(F.min("ts").alias("started"), F.max("step").alias("last"))
    emitted = steps.join(bounds, "epoch").where(F.expr(f"step % {max(int(every), 1)} = 0 OR step = last"))
    elapsed = F.col("ts").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")
    pace = F.col("step") / F.greatest(elapsed, F.lit(1e-9))
    return emitted.select(
        "epoch", "step", elapsed.alias("elapsed_seconds"), pace.alias("steps_per_second"),
        ((F.col("last") - F.col("step")) / F.greatest(pace, F.lit(1e-9))).alias("eta_epoch_seconds"),
    )


def best_so_far(history: DataFrame, score: str = "val_score", every: int = 1) -> DataFrame:
    """Evaluated epochs (each ``every``-th and the last) with the best earlier score and whether they beat it.

    One row per epoch, so the running maximum is over a short table.
    """
    last = history.agg(F.max("epoch").alias("last"))
    seen = history.crossJoin(F.broadcast(last)).where(F.expr(f"epoch % {max(int(every), 1)} = 0 OR epoch = last")).drop("last")
    before = F.max(score).over(Window.partitionBy(F.lit(0)).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("best_before", before).withColumn("best_updated", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The threshold with the best score, the first in sweep order on ties."""
    return scores.orderBy(F.desc("val_score"), "ord").limit(1)


def cache_totals(rows: DataFrame) -> DataFrame:
    """Entries and bytes by status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
