"""Change feeds that end in tables: manifests, and directory completion."""

import random

from pyspark.sql import functions as F

from fileledger.jobs import stream_queries
from fileledger.operators.compare import compare
from fileledger.operators.plans import copy_plan
from fileledger.operators.reports import completion
from fileledger.sources.versioned import VersionedTable
from fileledger.streaming.trees import CompletionTracker, ManifestTable
from tests.conftest import manifest


def test_versions_of_buckets(spark, tmp_path):
    t = VersionedTable(f"file://{tmp_path}/t", "k string, v bigint", "k", 4)
    rows = lambda *r: spark.createDataFrame(r, "k string, v bigint")
    assert t.latest(spark) == {} and t.current(spark).count() == 0
    buckets = lambda df: {r[0] for r in df.select(t.bucket()).distinct().collect()}
    first = rows(*((f"k{i}", i) for i in range(20)))
    t.write(first, 0, {}, buckets(first))
    assert sorted(map(tuple, t.current(spark).collect())) == sorted(map(tuple, first.collect()))
    one = rows(("k3", 33))
    (b,) = buckets(one)
    before = t.latest(spark, 1)
    t.write(one, 1, before, [b])  # the bucket holds this row alone now
    after = t.latest(spark)
    assert after[b] == 1 and {v for k, v in after.items() if k != b} <= {0}
    t.write(rows().limit(0), 2, after, [b])
    assert b not in t.latest(spark) and t.commit_of(spark, 7) is None and t.latest(spark, 2) == after
    assert t.current(spark).where("k = 'k3'").count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    t = VersionedTable(f"file://{tmp_path}/t", "k string, v bigint", "k", 2)
    rows = spark.range(0, 40_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        t.write(rows, 0, {}, [0, 1])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    now = t.current(spark)
    assert len(now.inputFiles()) > 4 and set(t.latest(spark)) == {0, 1}
    assert now.count() == 40_000 and now.agg(F.sum("v")).first()[0] == sum(range(40_000))


def test_files_of_a_feed_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "_FILE_ROWS", 100)
    files = stream_queries._write_feed(spark.range(1000).repartition(2), f"file://{tmp_path}/f", 3)
    sizes = [r[0] for r in spark.read.parquet(f"file://{tmp_path}/f").groupBy(F.input_file_name()).count().select("count").collect()]
    assert files == 4 and len(sizes) == 12 and max(sizes) <= 100 and sum(sizes) == 1000


def test_manifest_after_a_feed(spark, tmp_path):
    """Random changes in random batches, some twice in a batch, and batches that come again: the table is the newest change of every path."""
    rng = random.Random(1)
    paths = [f"d{i % 5}/f{i}" for i in range(40)]
    kept = ManifestTable(f"file://{tmp_path}/m", buckets=8)
    changes = [(rng.choice(paths), seq, rng.random() < 0.3, rng.randrange(1000)) for seq in range(150)]
    last = {}
    for c in changes:
        last[c[0]] = c
    rng.shuffle(changes)
    base = {r.rel_path: r for r in manifest(spark, {p: {} for p in paths}).collect()}
    schema = manifest(spark, {"x": {}}).schema.add("seq", "long").add("deleted", "boolean")
    batch = lambda rows: spark.createDataFrame([(*(v if n != "size" else size for n, v in zip(base[p].__fields__, base[p])), seq, gone or None) for p, seq, gone, size in rows], schema)
    files = []
    for i in range(6):
        part = changes[i * 25 : (i + 1) * 25]
        for _ in range(rng.choice((1, 2))):
            kept.add(batch(part + part[:5]), i)
        now = kept.table.current(spark)
        files.append(len(now.inputFiles()))
    assert max(files) <= 8  # what a step reads does not grow with the batches
    want = {p: c[3] for p, c in last.items() if not c[2]}
    state = kept.current(spark)
    assert {r.rel_path: r["size"] for r in state.collect()} == want
    dirs = manifest(spark, {p: {} for p in paths}).where("kind = 'dir'")
    plain = dirs.unionByName(batch([c for c in last.values() if not c[2]]).drop("seq", "deleted"))
    dst = manifest(spark, {p: {"size": 5} for p in paths[:20]})
    kept_tree = dirs.unionByName(state)
    for run in (compare, lambda a, b: copy_plan(a, b, overwrite=True)):
        assert sorted(map(str, run(kept_tree, dst).collect())) == sorted(map(str, run(plain, dst).collect()))
    again = ManifestTable(f"file://{tmp_path}/m", buckets=8)
    again.add(batch([(paths[0], 10**6, True, 0)]), 6)
    assert again.current(spark).where(F.col("rel_path") == paths[0]).count() == 0
    again.add(batch(changes[:1]).limit(0), 7)
    assert again.current(spark).count() == len(want) - (paths[0] in want)


def test_completion_over_batches(spark, tmp_path):
    t = CompletionTracker("r", f"file://{tmp_path}/c", buckets=4)
    batch = lambda *rows: spark.createDataFrame([("r", *r) for r in rows], "run string, dir string, event string, expected bigint")
    for _ in range(2):  # a replayed batch counts once
        t.add(batch(("", "announce", 1), ("a", "announce", 2), ("a", "child", None)), 0)
    assert {r.rel_path: r.complete for r in t.status(spark).collect()} == {"": False, "a": False}
    t = CompletionTracker("r", f"file://{tmp_path}/c", buckets=4)  # a restart goes on from the folder
    t.add(batch(("a", "child", None), ("", "child", None), ("ghost", "child", None)), 1)
    assert {r.rel_path: r.complete for r in t.status(spark).collect()} == {"": True, "a": True}
    assert sorted(r.rel_path for r in t.completed(spark, 1).collect()) == ["", "a"] and t.completed(spark, 0).count() == 0


def test_completion_against_all_events_at_once(spark, tmp_path):
    rng = random.Random(7)
    dirs = ["", *(f"d{i}" for i in range(4)), *(f"d{i}/e{j}" for i in range(4) for j in range(3)), *(f"d{i}/e{j}/f" for i in range(4) for j in range(3))]
    events = [(d, "announce", rng.randrange(3)) for d in dirs if rng.random() < 0.9]
    events += [(d, "child", None) for d in dirs for _ in range(3) if rng.random() < 0.8]
    events += [(d, "failed", None) for d in rng.sample(dirs[1:], 5)]
    rng.shuffle(events)
    schema = "run string, dir string, event string, expected bigint"
    t, told, seen = CompletionTracker("r", f"file://{tmp_path}/c", buckets=4), [], []
    for k in range(6):
        part = events[k * len(events) // 6 : (k + 1) * len(events) // 6]
        seen += part
        t.add(spark.createDataFrame([("r", *e) for e in part] + [("other", "d0", "failed", None)], schema), k)
        told += [r.rel_path for r in t.completed(spark, k).collect()]
        expected = {d: max(n for x, e, n in seen if x == d and e == "announce") for d in dirs if any(x == d and e == "announce" for x, e, _ in seen)}
        failed = {d for d, e, _ in seen if e == "failed"}
        rows = [(d, d in expected, expected.get(d, 0), d in failed, sum(x == d and e == "child" for x, e, _ in seen)) for d in dirs if d in expected or d in failed]
        whole = completion(spark.createDataFrame(rows, "rel_path string, announced boolean, expected bigint, failed boolean, processed bigint")).where("announced").drop("announced")
        assert sorted(map(tuple, t.status(spark).collect())) == sorted(map(tuple, whole.collect()))
    assert len(told) == len(set(told)) and {r.rel_path for r in t.status(spark).where("complete").collect()} <= set(told)
    assert len(t.table.current(spark).inputFiles()) <= 4
