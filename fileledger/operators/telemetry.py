"""Latency histograms, rates and percentiles of runs.

Histogram buckets keep three significant figures: a value below 2048 is its own
bucket, a larger one loses its low bits.  Buckets add up, so any window of ticks is
a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST_US, HIGHEST_US = 1, 3_600_000_000
EXACT_BELOW = 2048
COUNTERS = ("ops_started", "ops_finished", "bytes_copied", "files_copied")
BAND_HALF, BANDS_SHOWN, BAR_WIDTH = 4, 8, 24


def _shift(v: Column) -> Column:
    """Low bits that a value loses."""
    return F.when(v < EXACT_BELOW, 0).otherwise(F.length(F.bin(v)) - 11).cast("int")


def hdr_bucket(us: Column) -> Column:
    v = F.greatest(F.lit(LOWEST_US), F.least(F.lit(HIGHEST_US), us)).cast("bigint")
    return F.call_function("shiftleft", F.call_function("shiftright", v, _shift(v)), _shift(v))


def hdr_highest_equivalent(bucket: Column) -> Column:
    return bucket + F.call_function("shiftleft", F.lit(1).cast("bigint"), _shift(bucket)) - 1


def latency_histogram(samples: DataFrame, interval: str | None = None) -> DataFrame:
    """(run, side, op[, tick], bucket_low, count); empty ticks have no rows."""
    tick = [F.window("ts", interval)["start"].alias("tick")] if interval else []
    return samples.groupBy("run", "side", "op", *tick, hdr_bucket(F.col("latency_us")).alias("bucket_low")).agg(F.count(F.lit(1)).alias("count"))


def merge_window(buckets: DataFrame, start, end) -> DataFrame:
    """(run, side, op, bucket_low, count) over ticks in [start, end]."""
    return buckets.where((F.col("tick") >= F.lit(start)) & (F.col("tick") <= F.lit(end))).groupBy("run", "side", "op", "bucket_low").agg(F.sum("count").alias("count"))


def hist_percentile(buckets: DataFrame, quantiles: list[float], keys=("run", "side", "op")) -> DataFrame:
    """(keys, q, value_us): the highest value of the bucket that holds rank max(1, ceil(q n))."""
    b = buckets.groupBy(*keys, "bucket_low").agg(F.sum("count").alias("count"))
    w = Window.partitionBy(*keys)
    b = b.withColumns({"_cum": F.sum("count").over(w.orderBy("bucket_low").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("count").over(w)})
    b = b.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_n")))
    return b.where(F.col("_cum") >= rank).groupBy(*keys, "q").agg(hdr_highest_equivalent(F.min("bucket_low")).alias("value_us"))


def select_percentile(samples: DataFrame, p: float, keys=("run", "side", "op"), value: str = "latency_us") -> DataFrame:
    """(keys, value): the exact value at index min(floor(n p), n - 1) of the sorted values.

    Values are counted first, so a hot key is as many rows as it has distinct values.
    """
    c = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    c = c.withColumns({"_cum": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    index = F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)
    return c.where(F.col("_cum") > index).groupBy(*keys).agg(F.min(value).alias(value))


def band_panel(buckets: DataFrame, keys=("run", "side", "op")) -> DataFrame:
    """(keys, band, count, bar): counts by power of two; of the bands that have any, the eight around the fullest (the last of equals)."""
    band = (F.length(F.bin("bucket_low")) - 1).cast("bigint")
    b = buckets.where("count > 0").groupBy(*keys, band.alias("band")).agg(F.sum("count").alias("count"))
    w = Window.partitionBy(*keys)  # as many rows as a count has bits
    b = b.withColumns({"_i": F.row_number().over(w.orderBy("band")) - 1, "_n": F.count(F.lit(1)).over(w), "_top": F.max(F.struct("count", "band")).over(w)})
    b = b.withColumn("_mode", F.max(F.when(F.col("band") == F.col("_top.band"), F.col("_i"))).over(w))
    end = F.least(F.greatest(F.col("_mode") - BAND_HALF, F.lit(0)) + BANDS_SHOWN, F.col("_n"))
    shown = (F.col("_i") < end) & (F.col("_i") >= end - BANDS_SHOWN)
    return b.where(shown).select(*keys, "band", "count", F.call_function("div", F.col("count") * BAR_WIDTH, F.col("_top.count")).alias("bar"))


def run_stats(samples: DataFrame) -> DataFrame:
    """(run, samples, mean_us, throughput): per second between the first and the last sample."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return samples.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), F.avg("latency_us").alias("mean_us"), F.when(span > 0, F.count(F.lit(1)) / (span / 1e6)).otherwise(0.0).alias("throughput"))


def current_rates(progress: DataFrame, counters=COUNTERS) -> DataFrame:
    """(run, side, ts, <counter>_rate, pending): per second since the previous snapshot, 0 for no gap; started counts at least as many as finished."""
    w = Window.partitionBy("run", "side").orderBy("ts")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    p = progress.withColumns({"ops_started": F.greatest("ops_started", "ops_finished"), "_gap": gap})
    rate = lambda c: F.when(F.col("_gap") > 0, (F.col(c) - F.lag(c).over(w)) / F.col("_gap")).otherwise(0.0).alias(f"{c}_rate")
    return p.select("run", "side", "ts", *(rate(c) for c in counters), (F.col("ops_started") - F.col("ops_finished")).alias("pending"))


def average_rates(progress: DataFrame, counters=("ops_finished", "bytes_copied")) -> DataFrame:
    """(run, side, <counter>_rate) over the whole run, 0 for no time."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return progress.groupBy("run", "side").agg(*(F.when(span > 0, F.max(c) / span).otherwise(0.0).alias(f"{c}_rate") for c in counters))


def throughput_vs_latency(progress: DataFrame, buckets: DataFrame, p: float, tick: str = "1 hour") -> DataFrame:
    """(run, side, ts, ops_per_s, value_us): operations finished since the previous snapshot and the percentile of the ticks in between.

    A snapshot covers the ticks in (previous, this]; both sides meet on the time bin
    as well as on run and side, so the interval is an equi-join with a small rest.
    """
    w = Window.partitionBy("run", "side").orderBy("ts")
    r = current_rates(progress, ("ops_finished",)).withColumn("_before", F.lag("ts").over(w)).where("_before is not null")
    seconds = F.unix_seconds(F.lit("1970-01-01").cast("timestamp") + F.expr(f"interval {tick}"))
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = r.withColumn("_slot", F.explode(F.sequence(slot(F.col("_before")), slot(F.col("ts")))))
    right = buckets.select("run", "side", "tick", "bucket_low", "count", slot(F.col("tick")).alias("_slot"))
    j = left.join(right, ["run", "side", "_slot"]).where("tick > _before and tick <= ts")
    v = hist_percentile(j.select("run", "side", "ts", "bucket_low", "count"), [p], ("run", "side", "ts"))
    return r.join(v, ["run", "side", "ts"], "left").select("run", "side", "ts", F.col("ops_finished_rate").alias("ops_per_s"), "value_us")


def ordered_records(histograms: DataFrame, progress: DataFrame) -> DataFrame:
    """(run, unix_micros, seq, kind): records of both kinds in time order, histograms before progress at one time."""
    h = histograms.select("run", F.unix_micros("tick").alias("unix_micros"), F.lit(0).alias("kind")).distinct()
    p = progress.select("run", F.unix_micros("ts").alias("unix_micros"), F.lit(1).alias("kind")).distinct()
    w = Window.partitionBy("run").orderBy("unix_micros", "kind")
    return h.unionByName(p).select("run", "unix_micros", F.row_number().over(w).cast("bigint").alias("seq"), "kind")


def progress_from_json(c: Column, counters=COUNTERS) -> Column:
    """struct of counters; unknown keys are ignored, missing ones are null."""
    return F.from_json(c, ", ".join(f"{n} BIGINT" for n in counters))


def progress_snapshots(samples: DataFrame, every: str = "1 hour") -> DataFrame:
    """(run, side, ts, counters): running counts of samples at the end of every interval."""
    ts = F.window("ts", every)["end"]
    g = samples.groupBy("run", "side", ts.alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("op") == "open-create").alias("f"))
    w = Window.partitionBy("run", "side").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(w)
    return g.select("run", "side", "ts", run("n").alias("ops_started"), run("ok").alias("ops_finished"), run("b").alias("bytes_copied"), run("f").alias("files_copied"))
