"""Chunks, stored manifests, digests, plan files, rights, and rules of users."""

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileledger.functions import paths
from fileledger.functions.text import format_micros, format_nanos, format_ratio
from fileledger.operators import chunks, reports, telemetry
from fileledger.operators.compare import compare
from fileledger.functions.metadata import parse_preserve
from fileledger.operators.plans import acl_audit, copy_plan, link_plan
from fileledger.operators.policy import Rule
from fileledger.operators.removal import rm_plan
from fileledger.sources.stored import store_manifest, stored_manifest
from tests.conftest import FOO, manifest


def greedy(costs, budget):
    chunk, used, out = -1, 0, []
    for c in costs:
        if not used or used + c > budget:
            chunk, used = chunk + 1, 0
        used += c
        out.append(chunk)
    return out


def test_chunks(spark):
    m = manifest(spark, {f"d/{'n' * k}": {} for k in (1, 2, 3, 300)})
    got = {len(r.rel_path) - 2: r.chunk for r in chunks.chunk_manifest(m.where("rel_path like 'd/%'"), budget=140).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 300: 2}
    assert chunks.chunk_manifest(m.limit(0)).count() == 0


def test_states_through_tiles():
    """However a directory is cut into tiles, the state at the end is that of the greedy walk."""
    rng = random.Random(1)
    for _ in range(300):
        costs = [rng.choice((65, 66, 80, 300)) for _ in range(rng.randint(1, 60))]
        budget = rng.choice((64, 65, 140, 400, 5000))
        cuts = sorted({0, len(costs), *(rng.randrange(len(costs)) for _ in range(4))})
        state = (-1, 0)
        for a, b in zip(cuts, cuts[1:]):
            tile = np.array(costs[a:b])
            before, begun, left = chunks.tile_outcomes(tile, budget)
            state = chunks.carry(state, int(tile.sum()), before, begun, left, before + tile[: len(before)], budget)
            want = greedy(costs[:b], budget)
            assert state == (want[-1], sum(c for c, k in zip(costs[:b], want) if k == want[-1]))


def test_chunks_of_a_giant_directory(spark):
    """One directory of 60 000 names is many tiles, and its chunks are those of one walk."""
    names = sorted(f"f{i * 7919 % 1_000_003}" * (1 + i % 3) for i in range(60_000))
    m = spark.createDataFrame([(f"big/{n}",) for n in names] + [("small/a",), ("small/b",)], "rel_path string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.rel_path: r.chunk for r in chunks.chunk_manifest(m, budget=5000).collect()}
        tiles = m.repartitionByRange("rel_path").select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.count("*"), F.max("count")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tiles[0] == 16 and tiles[1] < 10_000
    assert [got[f"big/{n}"] for n in names] == greedy([len(n) + 64 for n in names], 5000)
    assert got["small/a"] == got["small/b"] == 0


def test_stored_manifests_join_without_an_exchange(spark, tmp_path):
    src = manifest(spark, FOO | {f"x/{i}": {"size": i} for i in range(50)})
    dst = manifest(spark, FOO | {f"x/{i}": {"size": i % 40} for i in range(48)})
    a, b = (store_manifest(m, f"file://{tmp_path}/{n}", 8) for n, m in (("a", src), ("b", dst)))
    again = stored_manifest(spark, f"file://{tmp_path}/a", 8)
    assert sorted(map(str, again.collect())) == sorted(map(str, src.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for run, kind in ((compare, "FullOuter"), (lambda x, y: copy_plan(x, y, overwrite=True), "LeftOuter")):
            for x in (a, again):
                lines = run(x, b)._jdf.queryExecution().executedPlan().toString().splitlines()
                depth = lambda line: len(line) - len(line.lstrip(" :+-"))
                at = next(i for i, line in enumerate(lines) if re.search(rf"SortMergeJoin \[rel_path#\d+\], \[rel_path#\d+\], {kind}", line))
                below = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
                join = "\n".join(lines[at:below])
                assert join.count("Bucketed: true") == 2 and "Exchange" not in join
            assert sorted(map(str, run(a, b).collect())) == sorted(map(str, run(src, dst).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", range(3))
def test_digests_against_each_error_in_turn(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(("a", "b", None)), i, "p", rng.choice((f"path {i} is gone", f"c{rng.randrange(6)}", None)) if seed else f"c{rng.randrange(4)}") for i in range(400)]
    want = {}
    for run, _, _, cause in rows:
        kept, total, dropped = want.get(run, ([], 0, 0))
        if cause not in kept and len(kept) < 5:
            kept = [*kept, cause]
        want[run] = (kept, total + 1, dropped + (cause not in kept))
    df = spark.createDataFrame(rows, "run string, seq bigint, path string, root_cause string")
    assert {r.run: (r.causes, r.total, r.suppressed) for r in reports.error_digest(df, 5).collect()} == want


def test_a_plan_of_one_directory_is_many_files(spark, tmp_path):
    p = spark.range(20_000).selectExpr("concat('d/f', id) as rel_path", "'copy' as action")
    reports.write_plan(p, str(tmp_path / "p"), files=8)
    back = spark.read.parquet(str(tmp_path / "p"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 6000


def test_bands_without_samples_do_not_count(spark):
    rows = [("r", "s", "o", 1 << b, n) for b, n in ((0, 5), (10, 9), (20, 3), (28, 1))] + [("q", "s", "o", 1 << b, 1 + (b == 14)) for b in range(2, 22, 2)]
    got = {}
    for r in telemetry.band_panel(spark.createDataFrame(rows, "run string, side string, op string, bucket_low bigint, count bigint")).collect():
        got.setdefault(r.run, {})[r.band] = (r["count"], r.bar)
    assert got["r"] == {0: (5, 13), 10: (9, 24), 20: (3, 8), 28: (1, 2)}
    assert sorted(got["q"]) == [6, 8, 10, 12, 14, 16, 18, 20]


def test_labels(spark):
    one = lambda f, *v: spark.range(1).select(f(*(F.lit(x).cast("bigint") for x in v))).first()[0]
    micros = {0: "0µs", 999: "999µs", 1000: "1.0ms", 12_250: "12.2ms", 1_500_000: "1.5s", 3_600_000_000: "3600.0s", None: "—"}
    assert {k: one(format_micros, k) for k in micros} == micros
    nanos = {0: "—", None: "—", 58: "58ns", 1_700: "1.7µs", 33_500_000: "33.5ms", 999_900_000: "999.9ms", 4_560_000_000: "4.6s"}
    assert {k: one(format_nanos, k) for k in nanos} == nanos
    assert [one(format_ratio, *v) for v in ((18, 10), (0, 10), (10, 0), (None, 10), (5, 2))] == ["1.8×", "—", "—", "—", "2.5×"]


def test_byte_paths_come_back(spark):
    rng = random.Random(3)
    raw = [bytes(rng.choice(b"a\\/x4\xc3\xa9\xff\x80 ") for _ in range(rng.randrange(12))) for _ in range(300)] + [b"a\\\xff", None]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in raw], "b binary").select("b", paths.escape_path_bytes("b").alias("e"))
    rows = df.select("b", "e", paths.unescape_path_bytes("e").alias("u")).collect()
    assert all(r.b == r.u for r in rows) and len({r.e for r in rows}) == len(set(raw))


def acl(*entries):
    return bytearray(struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in entries))


NOBODY = 0xFFFFFFFF
SHUT = acl((1, 7, NOBODY), (2, 0, 65534), (4, 0, NOBODY), (16, 5, NOBODY), (32, 5, NOBODY))
OPEN = acl((1, 7, NOBODY), (2, 7, 65534), (4, 5, NOBODY), (16, 7, NOBODY), (32, 5, NOBODY))
#: Grants no more than mode 0755.
SAME = acl((1, 7, NOBODY), (4, 5, NOBODY), (32, 5, NOBODY))


def audit(spark, src, dst, preserve="all"):
    full = lambda rows: manifest(spark, {p: {"kind": k, "mode": m, "acl": (True, a, d)} for p, (k, m, a, d) in rows.items()})
    return sorted((r.rel_path, r.principal, r.before, r.after) for r in acl_audit(full(src), full(dst), parse_preserve(preserve)).collect())


def test_a_list_that_is_dropped_widens(spark):
    f = {"": ("dir", 0o40755, None, None), "f": ("file", 0o100755, SHUT, None), "g": ("file", 0o100755, SAME, None), "h": ("file", 0o100755, None, None)}
    assert audit(spark, f, {}) == [("f", "group", "---", "r-x"), ("f", "user:65534", "---", "r-x")]
    assert audit(spark, f, {}, "all+acl") == []


def test_a_default_list_is_inherited(spark):
    src = {"d/f": ("file", 0o100640, None, None), "d/g": ("file", 0o100644, None, None), "e/f": ("file", 0o100640, None, None)}
    dst = {"d": ("dir", 0o40755, None, OPEN), "e": ("dir", 0o40755, OPEN, None)}
    assert audit(spark, src, dst) == [("d/f", "user:65534", "---", "r--")]


def test_new_directories_pass_a_default_list_on(spark):
    src = {"root/fresh": ("dir", 0o40750, None, None), "root/fresh/f": ("file", 0o100640, None, None), "root/old/f": ("file", 0o100640, None, None), "root/fresh/in": ("dir", 0o40755, None, None), "root/fresh/in/f": ("file", 0o100600, None, None)}
    dst = {"root": ("dir", 0o40755, None, OPEN), "root/old": ("dir", 0o40755, None, None)}
    assert audit(spark, src, dst) == [("root/fresh", "user:65534", "---", "r-x"), ("root/fresh/f", "user:65534", "---", "r--")]


def test_lists_that_are_kept_but_not_known(spark):
    src = manifest(spark, {"a": {"acl": (False, None, None)}, "b": {"acl": None}, "c": {"acl": (True, SHUT, None)}}).where("rel_path <> ''")
    got = sorted((r.rel_path, r.problem) for r in acl_audit(src, manifest(spark, {}), parse_preserve("all+acl")).collect())
    assert got == [("a", "source ACL is unknown"), ("b", "source ACL is unknown")]


def test_rules_of_users_in_plans(spark):
    src = manifest(spark, FOO | {"bar/big": {"size": 1000}, "new": {"size": 7}})
    dst = manifest(spark, FOO | {"bar/big": {"size": 999}, "bar/1.txt": {"size": 2}})
    rules = (Rule("big stays", "size > 500", "keep_big", of=("replace",)), Rule("not baz", "rel_path = 'baz'", "leave"), Rule("new later", F.col("dst_kind").isNull() & (F.col("kind") == "file"), "defer"))
    plain = {r.rel_path: r for r in copy_plan(src, dst, overwrite=True).collect()}
    got = {r.rel_path: (r.action, r.reason) for r in copy_plan(src, dst, overwrite=True, policy=rules).collect()}
    assert plain["bar/big"].action == "replace" and got["bar/big"] == ("keep_big", "big stays")
    assert got["baz"] == ("leave", "not baz") and not any(p.startswith("baz/") for p in got)
    assert got["new"] == ("defer", "new later") and got["bar/1.txt"] == ("replace", None)
    assert {p for p in plain if not p.startswith("baz/")} == set(got)
    linked = {r.rel_path: (r.action, r.rule) for r in link_plan(src, None, dst, overwrite=True, policy=rules[1:]).collect()}
    assert linked["baz"] == ("leave", "not baz") and linked["new"] == ("defer", "new later") and not any(p.startswith("baz/") for p in linked)


def test_rules_of_users_in_removals(spark):
    m = manifest(spark, FOO | {"bar/big": {"size": 1000}, "qux/z/y": {"size": 1}})
    got = {r.rel_path: (r.action, r.reason) for r in rm_plan(m, policy=(Rule("large files stay", "kind = 'file' and size > 500", "keep_large"),)).collect()}
    assert got["bar/big"] == ("keep_large", "large files stay")
    assert {p for p, (a, _) in got.items() if a == "keep"} == {"", "bar"}
    assert all(a == "remove" for p, (a, _) in got.items() if p not in ("", "bar", "bar/big"))
