"""The concurrency controller: sliding percentiles, and a window of requests that they grow and shrink.

In batch both are DataFrame expressions over chunks of time (`signal_chunks`,
`replay_controller`); `Ratio` is the same policy one sample at a time, for streams.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileledger.sources.scratch import written


@dataclass(frozen=True)
class RatioConfig:
    long_us: int = 10_000_000
    short_us: int = 1_000_000
    long_p: float = 0.10
    short_p: float = 0.50
    most_samples: int | None = 4096  # None: every sample of the windows counts
    grow_below: float = 1.3
    shrink_above: float = 1.8
    grow_by: int = 1
    shrink_by: int = 1
    start: int = 1
    least: int = 1
    most: int = 4096

    @property
    def low(self) -> int:
        return max(1, self.least)

    @property
    def high(self) -> int:
        return max(1, self.most)

    @property
    def first(self) -> int:
        return min(self.high, max(self.low, self.start))


def nearest_rank(ordered: list[int], p: float) -> int | None:
    return ordered[min(int(len(ordered) * p), len(ordered) - 1)] if ordered else None


def counted_rank(values: list[tuple[int, int]], p: float) -> int | None:
    """nearest_rank of values that are given with how often they occur."""
    total = sum(n for _, n in values)
    left = min(int(total * p), total - 1)
    for v, n in sorted(values):
        left -= n
        if left < 0:
            return v
    return None


class Ratio:
    """Grows the window while current latency is near the baseline, shrinks it when far above.

    Samples are held as (time, latency, how often).  Without most_samples, those that leave both windows at the
    same ticks are counted by latency (`merge`), so what is held grows with distinct latencies only.
    """

    def __init__(self, cfg: RatioConfig):
        self.cfg, self.cwnd = cfg, cfg.first
        self.held: deque[tuple[int, int, int]] = deque()
        self.fresh = False

    def sample(self, at: int, latency: int, n: int = 1) -> None:
        self.held.append((at, max(1, latency), n))
        while self.cfg.most_samples is not None and len(self.held) > self.cfg.most_samples:
            self.held.popleft()
        self.fresh = True

    def merge(self, tick_us: int) -> None:
        """Counts samples that no later tick tells apart; only where all count, as the order of the others matters."""
        if self.cfg.most_samples is not None:
            return
        last = lambda at, back: (at + back) // tick_us
        n: Counter = Counter()
        first: dict[tuple, int] = {}
        for at, v, k in self.held:
            key = (last(at, self.cfg.long_us), last(at, self.cfg.short_us), v)
            n[key] += k
            first[key] = min(at, first.get(key, at))
        self.held = deque(sorted((first[key], key[2], k) for key, k in n.items()))

    def tick(self, now: int) -> tuple[int | None, int | None, int]:
        """(baseline, current, cwnd).  A late sample counts if its time is within the long window, whenever it arrived."""
        self.held = deque(x for x in self.held if x[0] >= now - self.cfg.long_us)
        baseline = counted_rank([(v, n) for _, v, n in self.held], self.cfg.long_p)
        current = counted_rank([(v, n) for t, v, n in self.held if t >= now - self.cfg.short_us], self.cfg.short_p)
        if self.fresh and baseline and current:
            ratio = current / baseline
            step = self.cfg.grow_by if ratio < self.cfg.grow_below else -self.cfg.shrink_by if ratio > self.cfg.shrink_above else 0
            self.cwnd = min(self.cfg.high, max(self.cfg.low, self.cwnd + step))
        self.fresh = False
        return baseline, current, self.cwnd


SCHEMA = "run string, side string, op string, tick bigint, baseline_us bigint, current_us bigint, cwnd bigint"


UNIT = ["run", "side", "op"]
# Arrays of this module are never empty and are read by inline_outer: for inline, the planner asks first whether an array is empty, and so makes it twice.
#: Ticks of a chunk: what one row of the signal holds, together with at most most_samples of each tick, or without that number the distinct latencies of each.
CHUNK_TICKS = 512
#: Chunks whose totals meet in one row of the scan over chunks.
GROUP_CHUNKS = 1024


def dealt_samples(samples: DataFrame, tick_us: int, cfg: RatioConfig) -> DataFrame:
    """(run, side, op, at_us, v, n, due, chunk, own): samples by their tick's chunk, and once more (own: false) in the next chunk if that one's first ticks still see them.

    Chunks are much longer than the long window, so few samples are dealt twice, and none is copied by tick.
    n is 1, unless every sample counts: then those of a latency that enter and leave the windows at the same ticks are one
    row, with the time of the first.
    """
    span = -(-max(CHUNK_TICKS * tick_us, 2 * cfg.long_us) // tick_us) * tick_us
    at, due = F.col("at_us").cast("bigint"), F.col("due")
    s = samples.where("at_us is not null and latency_us is not null")
    s = s.select(*UNIT, at.alias("at_us"), F.greatest(F.lit(1), F.col("latency_us")).cast("bigint").alias("v"), (at + F.pmod(-at, F.lit(tick_us))).alias("due"))
    if cfg.most_samples is None:
        last = lambda back: F.call_function("div", F.col("at_us") + back - F.pmod(F.col("at_us") + back, F.lit(tick_us)), F.lit(tick_us))
        s = s.groupBy(*UNIT, "v", "due", last(cfg.long_us).alias("_long"), last(cfg.short_us).alias("_short")).agg(F.min("at_us").alias("at_us"), F.count(F.lit(1)).alias("n")).drop("_long", "_short")
    else:
        s = s.withColumn("n", F.lit(1).cast("bigint"))
    s = s.withColumn("chunk", F.call_function("div", due - 1 - F.pmod(due - 1, F.lit(span)), F.lit(span)))
    here, later = F.struct("chunk", F.lit(True).alias("own")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(False).alias("own"))
    seen_later = F.col("at_us") >= (F.col("chunk") + 1) * span + tick_us - cfg.long_us
    return s.select(*UNIT, "at_us", "v", "n", "due", F.explode(F.when(seen_later, F.array(here, later)).otherwise(F.array(here))).alias("in")).select(*UNIT, "at_us", "v", "n", "due", "in.*")


def signal_chunks(samples: DataFrame, tick_us: int, cfg: RatioConfig) -> DataFrame:
    """(run, side, op, chunk, ticks): the percentiles of each tick that had samples, by stretches of time.

    Within a chunk rows are numbered in order of time; a tick's windows are then slices
    between two counts, of which the newest most_samples are read, or all with how often they occur.
    """
    most = cfg.most_samples
    s = dealt_samples(samples, tick_us, cfg).repartition(*UNIT, "chunk")  # everything below works within a chunk
    due = F.col("due")

    # Of one tick's samples only the newest most_samples can ever count; the newest of all stands for the tick itself.
    newest = Window.partitionBy(*UNIT, "chunk", "due").orderBy(F.desc("at_us"), F.desc("v"))
    s = s.withColumn("k", F.row_number().over(newest))
    s = s if most is None else s.where(F.col("k") <= most)
    sample, tick = F.struct(F.col("at_us").alias("at"), F.col("v"), F.col("n")), F.struct(due.alias("at"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("bigint").alias("n"))
    s = s.select(*UNIT, "chunk", F.explode(F.when(F.col("own") & (F.col("k") == 1), F.array(sample, tick)).otherwise(F.array(sample))).alias("e")).select(*UNIT, "chunk", "e.*")
    by_time = Window.partitionBy(*UNIT, "chunk").orderBy("at")
    until = lambda back: F.count("v").over(by_time.rangeBetween(Window.unboundedPreceding, back))
    s = s.select(*UNIT, "chunk", "at", "v", "n", until(0).alias("end"), until(-cfg.long_us - 1).alias("long"), until(-cfg.short_us - 1).alias("short"))
    rows = s.groupBy(*UNIT, "chunk").agg(
        F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("at", "v") if most is not None else F.struct("at", "v", "n")))).alias("samples"),
        F.sort_array(F.collect_list(F.when(F.col("v").isNull(), F.struct(F.col("at").alias("tick"), "end", "long", "short")))).alias("ticks"),
    )

    def counted(t: Column, first: Column, p: float) -> Column:
        seen = F.slice("samples", (first + 1).cast("int"), (t["end"] - first).cast("int"))
        values = F.sort_array(F.transform(seen, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"))))
        total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        start = F.struct(F.least(F.floor(total * p), total - 1).alias("left"), F.lit(None).cast("bigint").alias("v"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["v"]).otherwise(a["v"]).alias("v")))["v"]

    def rank(t: Column, first: Column, p: float) -> Column:
        if most is None:
            return counted(t, first, p)
        first = F.greatest(first, t["end"] - most)
        n = t["end"] - first
        values = F.sort_array(F.transform(F.slice("samples", (first + 1).cast("int"), n.cast("int")), lambda x: x["v"]))
        return F.when(n > 0, F.element_at(values, F.least(F.floor(n * p) + 1, n).cast("int")))

    read = F.transform("ticks", lambda t: F.struct(t["tick"].alias("tick"), rank(t, t["long"], cfg.long_p).alias("baseline_us"), rank(t, t["short"], cfg.short_p).alias("current_us")))
    return rows.where(F.size("ticks") > 0).select(*UNIT, "chunk", read.alias("ticks"))


def ratio_signal(samples: DataFrame, tick_us: int = 1_000_000, cfg: RatioConfig = RatioConfig()) -> DataFrame:
    """(run, side, op, tick, baseline_us, current_us): percentiles of the long and the short window at every tick that had samples.

    samples: run, side, op, at_us, latency_us.  A tick sees the samples up to its time, of
    those the newest most_samples if there is such a number; a sample without a time or a latency is none.
    """
    return signal_chunks(samples, tick_us, cfg).select(*UNIT, F.inline_outer("ticks"))


def _clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def _step(t: Column, cfg: RatioConfig) -> Column:
    """By how much a tick moves the window."""
    ratio = t["current_us"] / t["baseline_us"]
    return F.when(ratio < cfg.grow_below, cfg.grow_by).when(ratio > cfg.shrink_above, -cfg.shrink_by).otherwise(0).cast("bigint")


def _through(f: Column, x: Column) -> Column:
    """f of x, of a clamped step (d, low, high)."""
    return _clamped(x + f["d"], f["low"], f["high"])


def _composed(steps: Column, of: Callable[[Column], Column], cfg: RatioConfig) -> Column:
    """One clamped step that does what all steps of an array do one after the other."""
    low, high = F.lit(cfg.low).cast("bigint"), F.lit(cfg.high).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("d"), low.alias("low"), high.alias("high"))
    return F.aggregate(steps, start, lambda f, e: F.struct((f["d"] + of(e)["d"]).alias("d"), _through(of(e), f["low"]).alias("low"), _through(of(e), f["high"]).alias("high")))


def _scanned(entries: Column, x: Column, through: Callable[[Column, Column], Column], row: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """row(entry, x before, x after) of every entry of an array, x carried through all of them."""
    start = F.struct(x.alias("x"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(entries, start, lambda a, e: F.struct(through(e, a["x"]).alias("x"), F.concat(a["out"], F.array(row(e, a["x"], through(e, a["x"])))).alias("out")))["out"]


def replay_controller(samples: DataFrame, tick_us: int = 1_000_000, cfg: RatioConfig = RatioConfig(), controller: str = "ratio") -> DataFrame:
    """(run, side, op, tick, baseline_us, current_us, cwnd) at every tick that had samples since the one before.

    samples: run, side, op, at_us, latency_us.  A tick's step depends on its percentiles
    alone, and a step is min(high, max(low, x + d)).  Such functions composed are such a
    function again, so the fold over time is a scan: steps are composed by chunk of ticks,
    chunks by group of chunks, groups in order of time; then the windows at which groups, chunks and
    ticks begin follow from the top down.  No unit is one task.
    """
    if controller != "ratio":
        cwnd = {"fixed": cfg.first, "unlimited": None}[controller]
        ticks = samples.where("at_us is not null and latency_us is not null").select(*UNIT, (F.col("at_us") + F.pmod(-F.col("at_us"), F.lit(tick_us))).cast("bigint").alias("tick")).distinct()
        return ticks.select(*UNIT, "tick", *(F.lit(v).cast("bigint").alias(c) for c, v in (("baseline_us", None), ("current_us", None), ("cwnd", cwnd))))
    low, high = F.lit(cfg.low).cast("bigint"), F.lit(cfg.high).cast("bigint")
    step = lambda t: {"d": _step(t, cfg), "low": low, "high": high}
    whole = lambda e: e["f"]
    chunks = written(signal_chunks(samples, tick_us, cfg), "controller-ticks")

    part = F.call_function("div", F.col("chunk") - F.pmod("chunk", F.lit(GROUP_CHUNKS)), F.lit(GROUP_CHUNKS)).alias("part")
    totals = chunks.select(*UNIT, part, F.struct("chunk", _composed(F.col("ticks"), step, cfg).alias("f")).alias("e"))
    parts = written(totals.groupBy(*UNIT, "part").agg(F.sort_array(F.collect_list("e")).alias("es")), "controller-parts")
    units = parts.select(*UNIT, F.struct("part", _composed(F.col("es"), whole, cfg).alias("f")).alias("e")).groupBy(*UNIT).agg(F.sort_array(F.collect_list("e")).alias("es"))

    begins = lambda name: (lambda e, before, after: F.struct(e[name].alias(name), before.alias("x")))
    enter = lambda e, x: _through(e["f"], x)
    at_parts = units.select(*UNIT, F.inline_outer(_scanned(F.col("es"), F.lit(cfg.first).cast("bigint"), enter, begins("part"), "struct<part: bigint, x: bigint>")))
    at_chunks = parts.join(at_parts, [*UNIT, "part"]).select(*UNIT, F.inline_outer(_scanned(F.col("es"), F.col("x"), enter, begins("chunk"), "struct<chunk: bigint, x: bigint>")))
    move = lambda t, x: _through(step(t), x)
    given = lambda t, before, after: F.struct(t["tick"].alias("tick"), t["baseline_us"].alias("baseline_us"), t["current_us"].alias("current_us"), after.alias("cwnd"))
    kind = "struct<tick: bigint, baseline_us: bigint, current_us: bigint, cwnd: bigint>"
    return chunks.join(at_chunks, [*UNIT, "chunk"]).select(*UNIT, F.inline_outer(_scanned(F.col("ticks"), F.col("x"), move, given, kind)))
