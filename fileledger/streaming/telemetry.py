"""Latency samples and progress as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fileledger.operators.controller import RatioConfig, Ratio, SCHEMA
from fileledger.operators.telemetry import hdr_bucket
from fileledger.sources.scratch import new_path


def histogram_snapshots(samples: DataFrame, interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(run, side, op, tick, bucket_low, count) per tumbling interval; samples later than `late` behind the newest are dropped."""
    w = F.window("ts", interval)
    g = samples.withWatermark("ts", late).groupBy("run", "side", "op", w.alias("w"), hdr_bucket(F.col("latency_us")).alias("bucket_low")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("run", "side", "op", F.col("w.start").alias("tick"), "bucket_low", "count")


def sliding_windows(samples: DataFrame, long: str = "10 seconds", tick: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(run, side, op, tick, bucket_low, count) of the window that ends at each tick; percentiles come from the buckets."""
    w = F.window("ts", long, tick)
    g = samples.withWatermark("ts", late).groupBy("run", "side", "op", w.alias("w"), hdr_bucket(F.col("latency_us")).alias("bucket_low")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("run", "side", "op", F.col("w.end").alias("tick"), "bucket_low", "count")


def _newest(frames: Iterator[pd.DataFrame], tick_us: int, cfg: RatioConfig) -> pd.DataFrame:
    """(at_us, latency_us) of a micro-batch in order of time: of each tick the newest most_samples, as no older one of it can count.  Frames are thinned as they come.

    Where every sample counts there is a third column n: those of a latency that enter and leave the windows at the same ticks are one row, with the time of the first.
    """
    names = ["at_us", "latency_us", *(["n"] if cfg.most_samples is None else [])]
    held = pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
    more = 2 * (cfg.most_samples or RatioConfig.most_samples)
    limit = more
    for f in frames:
        held = pd.concat([held, f[["at_us", "latency_us"]].dropna().assign(n=1)[names]], ignore_index=True)
        if len(held) > limit:
            held = _thinned(held, tick_us, cfg)
            limit = 2 * len(held) + more
    return _thinned(held, tick_us, cfg).astype("int64")


def _thinned(held: pd.DataFrame, tick_us: int, cfg: RatioConfig) -> pd.DataFrame:
    if cfg.most_samples is None:
        at = held["at_us"]
        held = held.groupby([-(-at // tick_us), (at + cfg.long_us) // tick_us, (at + cfg.short_us) // tick_us, held["latency_us"].rename("v")]).agg(at_us=("at_us", "min"), latency_us=("latency_us", "min"), n=("n", "sum"))
        return held.reset_index(drop=True).sort_values(["at_us", "latency_us"])
    held = held.sort_values(["at_us", "latency_us"])
    return held.groupby(-(-held["at_us"] // tick_us)).tail(cfg.most_samples)


def control(samples: DataFrame, tick_us: int = 1_000_000, cfg: RatioConfig = RatioConfig()) -> DataFrame:
    """The controller's rows as samples (run, side, op, at_us, latency_us) arrive.

    State by unit: the window size and the samples of the long window, at most
    most_samples, or all of them counted by latency.  A tick is emitted when a later sample shows that it has passed;
    samples older than the long window are ignored, others count whenever they come.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Ratio(cfg)
        tick = None
        if state.exists:
            cwnd, fresh, tick, times, values, counts = state.get
            c.cwnd, c.fresh = cwnd, fresh
            c.held.extend(zip(times, values, counts))
        rows = []
        for at, latency, *n in _newest(frames, tick_us, cfg).itertuples(index=False):
            due = -(-at // tick_us) * tick_us
            due = due if tick is None else max(due, tick)
            if tick is not None and at < tick - cfg.long_us:
                continue
            if tick is not None and due != tick:
                rows.append((*key, tick, *c.tick(tick)))
            tick = due
            c.sample(at, latency, *n)
        c.merge(tick_us)
        state.update((c.cwnd, c.fresh, tick, *([int(x[i]) for x in c.held] for i in range(3))))
        names = ["run", "side", "op", "tick", "baseline_us", "current_us", "cwnd"]
        yield pd.DataFrame(rows, columns=names).astype({"baseline_us": "Int64", "current_us": "Int64", "tick": "int64", "cwnd": "int64"})

    return samples.groupBy("run", "side", "op").applyInPandasWithState(step, SCHEMA, "cwnd bigint, fresh boolean, tick bigint, times array<bigint>, vals array<bigint>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def progress_rates(progress: DataFrame, counters=("ops_finished", "bytes_copied")) -> DataFrame:
    """(run, side, ts, <counter>_rate): per second since the last snapshot of the run and side, which is all the state there is."""
    names = ["run", "side", "ts", *(f"{c}_rate" for c in counters)]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            now = (int(r.ts.value // 1000), *(int(getattr(r, c)) for c in counters))
            if last is not None and now[0] < last[0]:
                continue
            gap = (now[0] - last[0]) / 1e6 if last is not None else 0
            rows.append((*key, r.ts, *((b - a) / gap if gap > 0 else 0.0 for a, b in zip((last or now)[1:], now[1:]))))
            last = now
        state.update(last)
        yield pd.DataFrame(rows, columns=names)

    state_schema = ", ".join(["ts bigint", *(f"{c} bigint" for c in counters)])
    schema = ", ".join(["run string, side string, ts timestamp", *(f"{c}_rate double" for c in counters)])
    return progress.groupBy("run", "side").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def control_rest(left: DataFrame, tick_us: int = 1_000_000, cfg: RatioConfig = RatioConfig()) -> DataFrame:
    """The rows of ticks that no later sample has shown to have passed, from what open_state tells of a stream of control."""
    names = ["run", "side", "op", "tick", "baseline_us", "current_us", "cwnd"]

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for run, side, op, cwnd, fresh, tick, times, values, counts in f.itertuples(index=False):
                c = Ratio(cfg)
                c.cwnd, c.fresh = cwnd, fresh
                c.held.extend(zip(times, values, counts))
                rows.append((run, side, op, tick, *c.tick(tick)))
            yield pd.DataFrame(rows, columns=names).astype({"baseline_us": "Int64", "current_us": "Int64", "tick": "int64", "cwnd": "int64"})

    state = left.select("run", "side", "op", *(F.col(f"groupState.{c}").alias(c) for c in ("cwnd", "fresh", "tick", "times", "vals", "counts")))
    return state.where("tick is not null").mapInPandas(last, SCHEMA)


def open_state(spark: SparkSession, log: str) -> DataFrame:
    """Keys and values that a stream of one stateful operator still holds, read from its checkpoint."""
    return spark.read.format("statestore").load(log).select("key.*", "value.*")


def histogram_rest(left: DataFrame) -> DataFrame:
    """Rows of intervals that the watermark has not closed, from what open_state tells of a stream of histogram_snapshots."""
    return _open_buckets(left, "start")


def sliding_rest(left: DataFrame) -> DataFrame:
    """The same of sliding_windows."""
    return _open_buckets(left, "end")


def _open_buckets(left: DataFrame, edge: str) -> DataFrame:
    """Keys are run, side, op, a window and a bucket in some order; the only value is the count."""
    window = next(f.name for f in left.schema.fields if isinstance(f.dataType, T.StructType))
    bucket, count = (n for n in left.columns if n not in ("run", "side", "op", window))
    return left.select("run", "side", "op", F.col(f"`{window}`.{edge}").alias("tick"), F.col(f"`{bucket}`").alias("bucket_low"), F.col(f"`{count}`").alias("count"))


def drain(stream: DataFrame, name: str, mode: str = "append", rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, to a table in the shared folder, and reads that.

    rest: makes the rows of what the stream still holds open at its end, so that the
    newest interval or tick is not missing.
    """
    spark = stream.sparkSession
    path, log = new_path(spark, name), new_path(spark, f"{name}-log")
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema).parquet(path)
    return out.unionByName(rest(open_state(spark, log)).select(*out.columns)) if rest else out


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of a folder as a file stream; files_per_batch bounds what a micro-batch, and so one of its groups, holds."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
