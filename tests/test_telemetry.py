import json
import random
import struct
from collections import Counter

import pandas as pd
import pyarrow.fs as pafs
import pytest

from fileledger.operators import controller
from fileledger.operators.controller import Ratio, RatioConfig, ratio_signal, replay_controller
from fileledger.sources import logs
from fileledger.sources.logs import COOKIE, decode_histogram, encode_histogram, read_histogram_logs
from fileledger.streaming.telemetry import _newest, control, control_rest, drain, progress_rates


def leb(n):
    v = (n << 1) ^ (n >> 63) if n < 0 else n << 1
    v &= (1 << 64) - 1
    out = b""
    for _ in range(8):
        if v < 0x80:
            return out + bytes([v])
        out += bytes([v & 0x7F | 0x80])
        v >>= 7
    return out + bytes([v])


def encode(counts):
    """Version 2 bytes of {index: count}."""
    body, at = b"", 0
    for i, c in sorted(counts.items()):
        if i > at:
            body += leb(-(i - at))
        body += leb(c)
        at = i + 1
    return struct.pack(">iiiiqqd", COOKIE | 0x10, len(body), 0, 3, 1, 3_600_000_000, 1.0) + body


def test_histogram_blob():
    # Index 5 is value 5; index 2048 starts the buckets of width 2.
    assert decode_histogram(encode({5: 3, 2047: 1, 2048: 2, 2049: 7, 3072: 1 << 40})) == [(5, 3), (2047, 1), (2048, 2), (2050, 7), (4096, 1 << 40)]


def test_histograms_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.choice([0, 1, 5, 1023, 1024, 2047, 2048, 4096 + 2 * rng.randrange(1000), (1024 + rng.randrange(1024)) << rng.randrange(20)]): rng.choice([1, 63, 64, 8192, 1 << 40, (1 << 62) + 5]) for _ in range(rng.randint(0, 9))}
        assert dict(decode_histogram(encode_histogram(sorted(counts.items())))) == {(k >> s) << s if (s := max(0, k.bit_length() - 11)) else k: n for k, n in counts.items()}


MAGIC = b"SOME-LOG\n"
HEADER = json.dumps({"format_version": 2, "later": 1}).encode()


def framed(body):
    return struct.pack("<I", len(body)) + body


def test_logs(spark, tmp_path):
    h = b"\0" + struct.pack("<QBBQ", 1_000_000, 1, 8, 4) + encode({10: 4})
    p = b"\1" + struct.pack("<Q", 2_000_000) + b'{"ops_started": 1}'
    head = MAGIC + framed(HEADER)
    (tmp_path / "one").write_bytes(head + framed(h) + framed(p) + framed(h)[:-3])
    (tmp_path / "two").write_bytes(head + framed(p) + framed(b"\0short") + framed(p))  # too short a record ends a log
    headers, buckets, progress = read_histogram_logs(spark, f"file://{tmp_path}", MAGIC)
    assert json.loads(headers.first().header)["later"] == 1 and headers.count() == 2
    assert [(r.side, r.op, r.bucket_low, r["count"]) for r in buckets.collect()] == [("destination", "open-create", 10, 4)]
    assert [r.json for r in progress.collect()] == ['{"ops_started": 1}'] * 2
    for bad, why in ((b"OTHER-LOG\n", "bad magic"), (MAGIC + framed(HEADER)[:9], "ends too early"), (MAGIC + struct.pack("<I", 1 << 21), "header of"), (MAGIC + framed(b'{"format_version": 3}'), "format version"), (head + struct.pack("<I", 1 << 21), "record of"), (head + framed(b"\2" + bytes(8)), "record kind"), (head + framed(b"\0" + struct.pack("<QBBQ", 1, 2, 0, 0) + encode({})), "unknown side")):
        (tmp_path / "one").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            logs.read_log_records(spark, f"file://{tmp_path}/on*", MAGIC).collect()
    assert logs.read_log_records(spark, f"file://{tmp_path}/nothing*", MAGIC).count() == 0


def random_log(rng, n, longest=3000):
    bodies = [b"\1" + struct.pack("<Q", i) + b'{"x": "%s"}' % (b"y" * rng.randrange(longest)) for i in range(n)]
    return MAGIC + framed(HEADER) + b"".join(map(framed, bodies)), bodies


def write_indexed(path, data, bodies):
    out = logs._LogWriter(pafs.LocalFileSystem(), str(path), MAGIC + framed(HEADER))
    for b in bodies:
        out.write(b)
    out.close()
    assert path.read_bytes() == data


@pytest.mark.parametrize("indexed", [True, False])
def test_ranges_of_a_log_give_every_record_once(tmp_path, monkeypatch, indexed):
    monkeypatch.setattr(logs, "INDEX_BYTES", 4096)
    monkeypatch.setattr(logs, "READ_BYTES", 1000)
    rng = random.Random(3)
    data, bodies = random_log(rng, 200)
    write_indexed(tmp_path / "a.log", data, bodies)
    whole = list(logs.read_range(pafs.LocalFileSystem(), logs.LogRange(str(tmp_path / "a.log"), 0, len(data), False), MAGIC))
    assert len(whole) == 201 and [json.loads(r[-1])["x"] for r in whole[1:]] == [json.loads(b[9:])["x"] for b in bodies]
    for _ in range(30):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randrange(12)))})
        got = [r for a, b in zip(cuts, cuts[1:]) for r in logs.read_range(pafs.LocalFileSystem(), logs.LogRange(str(tmp_path / "a.log"), a, b, indexed, True), MAGIC)]
        assert got == whole


def test_many_ranges_in_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "INDEX_BYTES", 1 << 20)
    data, bodies = random_log(random.Random(5), 3000)
    write_indexed(tmp_path / "a.log", data, bodies)
    records = logs.read_log_records(spark, f"file://{tmp_path}", MAGIC, rangeBytes=100_000)
    assert records.rdd.getNumPartitions() == -(-len(data) // 100_000)
    assert sorted(json.loads(r.json)["x"] for r in logs.log_progress(records).collect()) == sorted(json.loads(b[9:])["x"] for b in bodies)


def test_logs_are_tailed(spark, tmp_path):
    """Three steps of two logs, cut within the header, within a record, and whole; a third log comes last."""
    rng = random.Random(4)
    (tmp_path / "logs").mkdir()
    made = {n: random_log(rng, 40)[0] for n in ("a", "b", "c")}
    out = str(tmp_path / "out")
    counts = []
    for names, share in (("ab", 0.0001), ("ab", 0.37), ("ab", 0.37), ("abc", 1)):
        for n in names:
            (tmp_path / "logs" / n).write_bytes(made[n][: max(15, int(len(made[n]) * share))])
        stream = logs.tail_log_records(spark, f"file://{tmp_path}/logs", MAGIC)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        counts.append(spark.read.schema(stream.schema).parquet(out).count())
    assert counts[0] == 0 and 0 < counts[1] == counts[2] < counts[3] == 3 * 41
    got = sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).drop("buckets").collect()), key=str)
    assert got == sorted(map(tuple, logs.read_log_records(spark, f"file://{tmp_path}/logs", MAGIC).drop("buckets").collect()), key=str)


def test_defaults_of_the_controller():
    cfg = RatioConfig()
    assert (cfg.start, cfg.least, cfg.most, cfg.grow_below, cfg.shrink_above, cfg.grow_by, cfg.shrink_by) == (1, 1, 4096, 1.3, 1.8, 1, 1)
    assert (cfg.long_us, cfg.short_us, cfg.long_p, cfg.short_p, cfg.most_samples) == (10_000_000, 1_000_000, 0.1, 0.5, 4096)
    assert (RatioConfig(start=0).first, RatioConfig(start=9, most=5).first, RatioConfig(start=0, least=0, most=0).first) == (1, 5, 1)


# Ratios of 1.8 and below hold, 1.81 and above shrink.
@pytest.mark.parametrize("current, want", [(500, 21), (600, 21), (645, 21), (650, 20), (750, 20), (900, 20), (905, 19), (950, 19), (999, 19), (1000, 19), (2500, 19), (450, 21)])
def test_window_steps(spark, current, want):
    cfg = RatioConfig(long_us=100_000_000, short_us=10, start=20)
    samples = [(i, 500) for i in range(100)] + [(1000, current)]
    c = Ratio(cfg)
    for x in samples:
        c.sample(*x)
    assert c.tick(1000)[2] == want
    if current in (900, 905, 600):
        df = spark.createDataFrame([("r", "s", "o", *x) for x in samples], "run string, side string, op string, at_us bigint, latency_us bigint")
        rows = {r.tick: r.cwnd for r in replay_controller(df, tick_us=500, cfg=cfg).collect()}
        assert rows[1000] - rows[500] == want - 20


def random_samples(seed, n=400):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([10_000, 200_000, 2_000_000])
        out.append((f"r{rng.randint(0, 1)}", "source", "stat", at, rng.randint(100, 3000)))
    return out


def brute_replay(samples, tick_us, cfg):
    """Every tick's percentiles from all samples so far, with nothing carried but the window size."""
    out = []
    for run in sorted({s[0] for s in samples}):
        mine = sorted((s[3], s[4]) for s in samples if s[0] == run)
        cwnd = min(max(1, cfg.most), max(1, cfg.least, cfg.start))
        for tick in sorted({-(-t // tick_us) * tick_us for t, _ in mine}):
            seen = [x for x in mine if x[0] <= tick][-cfg.most_samples :]
            rank = lambda v, p: sorted(v)[min(int(len(v) * p), len(v) - 1)] if v else None
            base = rank([v for t, v in seen if t >= tick - cfg.long_us], cfg.long_p)
            cur = rank([v for t, v in seen if t >= tick - cfg.short_us], cfg.short_p)
            if base and cur:
                cwnd = max(cfg.least, min(cfg.most, cwnd + (cfg.grow_by if cur / base < 1.3 else -cfg.shrink_by if cur / base > 1.8 else 0)))
            out.append((run, tick, base, cur, cwnd))
    return sorted(out)


def test_replay_and_stream_against_brute_force(spark, tmp_path):
    rows, cfg = random_samples(4), RatioConfig(most=22, least=18)
    schema = "run string, side string, op string, at_us bigint, latency_us bigint"
    df = spark.createDataFrame(rows, schema)
    want = brute_replay(rows, 1_000_000, cfg)
    pick = lambda d: sorted((r.run, r.tick, r.baseline_us, r.current_us, r.cwnd) for r in d.collect())
    assert pick(replay_controller(df, cfg=cfg)) == want
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = pick(drain(control(spark.readStream.schema(schema).parquet(str(tmp_path / "s")), cfg=cfg), "control"))
    last = {run: max(t for r, t, *_ in want if r == run) for run in ("r0", "r1")}
    assert got == [w for w in want if w[1] != last[w[0]]]
    rest = lambda left: control_rest(left, cfg=cfg)
    assert pick(drain(control(spark.readStream.schema(schema).parquet(str(tmp_path / "s")), cfg=cfg), "control", rest=rest)) == want


@pytest.mark.parametrize("seed, tick_us, cfg, chunk, group", [
    (1, 1_000_000, RatioConfig(most=6), 4, 2),
    (2, 50_000, RatioConfig(most=9, least=3, most_samples=7), 16, 3),
    (3, 700_000, RatioConfig(long_us=3_000_000, short_us=250_000, start=50, grow_by=2, shrink_by=3), 512, 1024),
    (4, 50_000, RatioConfig(long_us=10_000_000, short_us=1_000_000, most=4, most_samples=30), 1, 1),
])
def test_replay_as_a_scan(spark, monkeypatch, seed, tick_us, cfg, chunk, group):
    monkeypatch.setattr(controller, "CHUNK_TICKS", chunk)
    monkeypatch.setattr(controller, "GROUP_CHUNKS", group)
    rng = random.Random(seed)
    rows, at = [], -50_000_000
    for _ in range(600):
        at += rng.choice([0, 1, 10_000, 50_000, 400_000, 1_000_000, 30_000_000 if rng.random() < 0.1 else 7])
        rows.append((f"r{rng.randint(0, 1)}", "source", "stat", at, int(rng.choice([100, 150, 400]) * rng.uniform(0.8, 1.3)) * rng.randint(0, 3)))
    df = spark.createDataFrame(rows + [("r0", "source", "stat", None, 5), ("r1", "source", "stat", 5, None)], "run string, side string, op string, at_us bigint, latency_us bigint")
    got = sorted((r.run, r.tick, r.baseline_us, r.current_us, r.cwnd) for r in replay_controller(df, tick_us, cfg).collect())
    assert got == brute_replay([(*r[:4], max(1, r[4])) for r in rows], tick_us, cfg)
    assert len({g[4] for g in got}) > 2
    assert replay_controller(df.limit(0), tick_us, cfg).count() == 0


def test_no_sample_is_copied_by_tick(spark):
    """At 50 ms ticks a sample is in 200 windows; it is dealt to two chunks at most, and few are."""
    df = spark.range(20_000).selectExpr("cast(id % 1 as string) as run", "cast(id % 1 as string) as side", "cast(id % 1 as string) as op", "id * 7919 as at_us", "id % 100 as latency_us")
    share = 10_000_000 / (controller.CHUNK_TICKS * 50_000)
    assert 20_000 <= controller.dealt_samples(df, 50_000, RatioConfig()).count() <= 20_000 * (1 + share) + 1300
    plan = ratio_signal(df, 50_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan and "InPandas" not in plan


def test_fixed_controllers(spark):
    df = spark.createDataFrame([("r", "s", "o", 5, 10), ("r", "s", "o", 6, 10)], "run string, side string, op string, at_us bigint, latency_us bigint")
    assert [(r.tick, r.cwnd) for r in replay_controller(df, 10, RatioConfig(start=7), "fixed").collect()] == [(10, 7)]
    assert [(r.tick, r.cwnd) for r in replay_controller(df, 10, controller="unlimited").collect()] == [(10, None)]


def test_late_samples_and_hot_ticks_of_a_stream(spark, tmp_path):
    """Two micro-batches, the second with samples of all times; against the policy fed one sample at a time."""
    rng, cfg = random.Random(9), RatioConfig(most_samples=5, long_us=4_000_000, short_us=1_000_000, most=30)
    rows = [(int(rng.uniform(0, 30_000_000)), rng.randint(50, 400)) for _ in range(500)]
    first = sorted(r for r in rows if r[0] < 20_000_000 and rng.random() < 0.8)
    second = sorted(set(rows) - set(first))
    c, tick, want = Ratio(cfg), None, []
    for part in (first, second):
        for at, v in part:
            if tick is not None and at < tick - cfg.long_us:
                continue
            due = max(-(-at // 1_000_000) * 1_000_000, tick or 0)
            if tick is not None and due != tick:
                want.append((tick, *c.tick(tick)))
            tick = due
            c.sample(at, v)
    want.append((tick, *c.tick(tick)))
    schema = "run string, side string, op string, at_us bigint, latency_us bigint"
    for part in (first, second):
        spark.createDataFrame([("r", "s", "o", *x) for x in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = drain(control(stream, cfg=cfg), "late", rest=lambda left: control_rest(left, cfg=cfg))
    assert sorted((r.tick, r.baseline_us, r.current_us, r.cwnd) for r in got.collect()) == sorted(want)


def test_micro_batches_are_thinned_as_they_come():
    rng = random.Random(2)
    cfg = RatioConfig(most_samples=10)
    frames = [pd.DataFrame({"run": "r", "at_us": [rng.randrange(3000) for _ in range(200)], "latency_us": [rng.randrange(50) for _ in range(200)]}) for _ in range(20)]
    got = _newest(iter(frames), 1000, cfg)
    rows = sorted((a, v) for f in frames for a, v in zip(f["at_us"], f["latency_us"]))
    want = [x for due in range(4) for x in [r for r in rows if -(-r[0] // 1000) == due][-10:]]
    assert [tuple(x) for x in got.itertuples(index=False)] == want
    assert len(_newest(iter([]), 1000, cfg)) == 0


def dense_samples(seed, n):
    """Many samples in few ticks, some on the ticks themselves; latencies rise."""
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.randrange(-2_000_000, 14_000_000), 1_000_000 * rng.randrange(-2, 14), 1_000_000 * rng.randrange(-2, 14) + 1])
    return [("r0", "source", "stat", t, rng.choice([0] + [100, rng.randrange(90, 400)] * 12) * 3 + max(0, t) // 20_000 * (rng.random() < 0.97)) for t in (at() for _ in range(n))]


@pytest.mark.parametrize("tick_us, cfg", [(1_000_000, RatioConfig(most_samples=None)), (700_000, RatioConfig(long_us=3_000_000, short_us=250_000, most_samples=None)), (50_000, RatioConfig(long_us=5_000_000, most_samples=None))])
def test_windows_without_a_number_of_samples(spark, tmp_path, monkeypatch, tick_us, cfg):
    """More samples than 4096 in a window count all, in batch and in a stream of several frames."""
    monkeypatch.setattr(controller, "CHUNK_TICKS", 4)
    rows = dense_samples(6, 15_000)
    whole = RatioConfig(long_us=cfg.long_us, short_us=cfg.short_us, most_samples=10**6)
    want = brute_replay([(*r[:4], max(1, r[4])) for r in rows], tick_us, whole)
    schema = "run string, side string, op string, at_us bigint, latency_us bigint"
    df = spark.createDataFrame(rows, schema)
    pick = lambda d: sorted((r.run, r.tick, r.baseline_us, r.current_us, r.cwnd) for r in d.collect())
    assert pick(replay_controller(df, tick_us, cfg)) == want
    if tick_us == 1_000_000:
        assert pick(replay_controller(df, tick_us)) != want
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    assert pick(drain(control(stream, tick_us, cfg), "dense", rest=lambda left: control_rest(left, tick_us, cfg))) == want


def test_counted_samples_of_a_stream(spark, tmp_path):
    """Two micro-batches, the second with late samples, against the policy fed one sample at a time; the state holds distinct latencies only."""
    rng, cfg = random.Random(3), RatioConfig(long_us=4_000_000, most_samples=None)
    rows = [(int(rng.uniform(0, 20_000_000)), rng.choice([100, 150, 300])) for _ in range(20_000)]
    first = sorted(r for r in rows if r[0] < 12_000_000 and rng.random() < 0.8)
    second = sorted((Counter(rows) - Counter(first)).elements())
    c, tick, want = Ratio(cfg), None, []
    for part in (first, second):
        for at, v in part:
            if tick is not None and at < tick - cfg.long_us:
                continue
            due = max(-(-at // 1_000_000) * 1_000_000, tick or 0)
            if tick is not None and due != tick:
                want.append((tick, *c.tick(tick)))
            tick = due
            c.sample(at, v)
    want.append((tick, *c.tick(tick)))
    schema = "run string, side string, op string, at_us bigint, latency_us bigint"
    for part in (first, second):
        spark.createDataFrame([("r", "s", "o", *x) for x in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    sizes = []

    def rest(left):
        sizes.extend(len(r.t) for r in left.selectExpr("groupState.times as t").collect())
        return control_rest(left, cfg=cfg)

    got = drain(control(stream, cfg=cfg), "counted", rest=rest)
    assert sorted((r.tick, r.baseline_us, r.current_us, r.cwnd) for r in got.collect()) == sorted(want)
    assert 0 < sizes[0] <= 3 * 12


def test_stream_rates(spark, tmp_path):
    rows = [("r", "source", "2024-01-01 00:00:00", 0, 0), ("r", "source", "2024-01-01 00:00:10", 50, 100), ("r", "source", "2024-01-01 00:00:10", 60, 100)]
    spark.createDataFrame(rows, "run string, side string, ts string, ops_finished bigint, bytes_copied bigint").selectExpr("run", "side", "cast(ts as timestamp) ts", "ops_finished", "bytes_copied").coalesce(1).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "p")).schema).parquet(str(tmp_path / "p"))
    assert sorted(r.ops_finished_rate for r in drain(progress_rates(s), "rates").collect()) == [0.0, 0.0, 5.0]
