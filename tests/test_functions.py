import pytest
from pyspark.sql import functions as F

from fileledger.functions import filters, metadata, paths, text
from fileledger.operators.permissions import chmod_plan
from fileledger.operators.telemetry import hdr_bucket, hdr_highest_equivalent
from tests.conftest import FOO, manifest


@pytest.mark.parametrize(
    "pattern, path, is_dir, want",
    [("*.rs", "src/foo.rs", False, True), ("**/*.rs", "foo.rs", False, True), ("**/*.rs", "a/b/foo.rs", False, True), ("file?.txt", "file12.txt", False, False), ("/src", "foo/src", True, False), ("/src", "src", True, True), ("build/", "build", False, False), ("src/*.rs", "other/src/foo.rs", False, False), ("src/*.rs", "src/foo.rs", False, True), ("src/lib/", "other/src/lib", True, False), ("target/", "a/b/target", True, True), ("a/**", "a/b/c", False, True), ("a/**/z", "a/z", False, True), ("[!a]x", "bx", False, True), ("[!a]x", "ax", False, False), ("*.{log,tmp}", "d/x.tmp", False, True)],
)
def test_patterns(spark, pattern, path, is_dir, want):
    row = spark.range(1).select(filters.matches(filters.parse_pattern(pattern), F.lit(path), F.lit(is_dir)).alias("m")).first()
    assert row.m is want


@pytest.mark.parametrize("bad", ["", "/", "//", "[a", "{a"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        filters.parse_pattern(bad)


def test_filter_text():
    s = filters.FilterSettings.from_text("# c\n--include *.txt\n\n--exclude a/\n")
    assert [p.text for p in s.include] == ["*.txt"] and [p.text for p in s.exclude] == ["a/"]
    with pytest.raises(ValueError, match="line 2"):
        filters.FilterSettings.from_text("--include a\nnonsense")
    with pytest.raises(ValueError):
        filters.FilterSettings.from_args(include=["a"], text="--include b")


def test_durations():
    day = 86400 * filters.NS
    assert filters.parse_duration("30d") == 30 * day
    assert filters.parse_duration("6m") == 360 * filters.NS
    assert filters.parse_duration("6M") > 180 * day
    assert filters.parse_duration("1h 30m") == 5400 * filters.NS
    with pytest.raises(ValueError):
        filters.parse_duration("soon")


def test_age_boundary_future_and_null(spark):
    m = manifest(spark, {"old": ("file", 1, 1000), "edge": ("file", 1, 1500), "new": ("file", 1, 1501), "future": ("file", 1, 9999)})
    got = {r.rel_path: r.a for r in m.select("rel_path", filters.time_filter("500s", None, 2000).alias("a")).collect()}
    assert (got["old"], got["edge"], got["new"], got["future"]) == ("matched", "matched", "too_new_modified", "too_new_modified")
    assert m.where("rel_path = 'old'").select(filters.time_filter(None, "1s", 2000).alias("a")).first().a == "too_new_created"


@pytest.mark.parametrize(
    "mode, spec, is_dir, want",
    [(0o644, "g+w", False, 0o664), (0o755, "o=", False, 0o750), (0o1755, "o=", False, 0o750), (0, "u=rwx,go=rx", False, 0o755), (0o644, "a+X", False, 0o644), (0o744, "a+X", False, 0o755), (0o644, "a+X", True, 0o755), (0o750, "g+rwxs", True, 0o2770), (0o755, "+t", True, 0o1755), (0o755, "u+t", False, 0o755), (0o1755, "u-t", False, 0o1755), (0o1755, "o-t", False, 0o755), (0o4755, "644", False, 0o644)],
)
def test_mode_programs(spark, mode, spec, is_dir, want):
    assert spark.range(1).select(metadata.apply_mode(F.lit(mode), metadata.parse_mode(spec), F.lit(is_dir)).alias("m")).first().m == want


@pytest.mark.parametrize("bad", ["u+q", "8", "77777", "", "g~w"])
def test_bad_modes(bad):
    with pytest.raises(ValueError):
        metadata.parse_mode(bad)


@pytest.mark.parametrize(
    "mode, kw, want",
    [(0o644, {"mode": "g+r"}, (None, None, None, None)), (0o644, {"group": "2000"}, (None, None, 2000, None)), (0o2755, {"group": "2000"}, (None, None, 2000, 0o2755)), (0o4755, {"mode": "g+r", "owner": "2000"}, (None, 2000, None, 0o4755)), (0o4755, {"owner": "2000", "no_setid": True}, (0o755, 2000, None, 0o755))],
)
def test_chmod_plans(spark, mode, kw, want):
    r = chmod_plan(manifest(spark, {"f": {"mode": 0o100000 | mode}}), **kw).where("rel_path = 'f'").first()
    assert (r.pre_chmod, r.chown_uid, r.chown_gid, r.chmod) == want


def test_chmod_leaves_links(spark):
    r = chmod_plan(manifest(spark, {"l": {"kind": "symlink", "mode": 0o120777}}), mode="g-w", group="2000").where("rel_path = 'l'").first()
    assert (r.chmod, r.chown_gid, r.change) == (None, 2000, "group 1000->2000")


def test_grammars():
    assert metadata.parse_compare("f:mtime,size d:mtime")["file"] == {"mtime", "size"}
    assert metadata.parse_owner_dsl("alice f:5", {"alice": 7}) == {"file": 5, "dir": 7, "symlink": 7, "other": 7}
    assert metadata.validate_update_compare(frozenset({"mtime", "size"}), metadata.parse_preserve("none")) == ["mtime"]
    for f, bad in ((metadata.parse_compare, "q:size"), (metadata.parse_preserve, "l:acl"), (metadata.parse_preserve, "f:acl,0700"), (metadata.parse_owner_dsl, "1 2"), (metadata.parse_metadata_cmp, "colour")):
        with pytest.raises(ValueError):
            f(bad)


def test_io_tokens(spark):
    sizes = [0, 1, 10, 11, 20, 21, 100]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    assert [r.t for r in df.select(metadata.iops_tokens(F.col("s"), 10).alias("t")).collect()] == [1, 1, 1, 2, 2, 3, 10]
    assert df.select(metadata.iops_tokens(F.col("s"), 0).alias("t")).first().t is None


def test_paths_and_text(spark):
    r = spark.createDataFrame([("a/b\\c/d",)], "p string").select(paths.ancestors("p").alias("up"), paths.escape_path("p").alias("e"), paths.unescape_path(paths.escape_path("p")).alias("u"), paths.escape_path_bytes(F.lit(b"a\\\xff")).alias("x"), text.format_micros(F.lit(12_340)).alias("m"), text.human_bytes(F.lit(1536)).alias("h"), paths.parent("p").alias("par"), paths.name("p").alias("n")).first()
    assert (r.up, r.e, r.u, r.x, r.m, r.h, r.par, r.n) == (["", "a", "a/b\\c"], "a/b\\\\c/d", "a/b\\c/d", "a\\\\\\xff", "12.3ms", "1.50 KiB", "a/b\\c", "d")


def test_sizes_halfway_between_two_decimals(spark):
    """The even one of two that are as near; no marks between thousands."""
    sizes = {441_984: "431.62 KiB", 442_112: "431.75 KiB", 952_448: "930.12 KiB", 1_048_575: "1024.00 KiB", 1152: "1.12 KiB", 1408: "1.38 KiB", 5 << 50: "5.00 PiB", (1 << 60) + 5: "1024.00 PiB", 1023: "1023 B"}
    assert {r.s: r.h for r in spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", text.human_bytes(F.col("s")).alias("h")).collect()} == sizes


def test_buckets(spark):
    values = [0, 1, 2047, 2048, 2049, 4095, 4096, 123_456_789, 10**11]
    for v, b, top in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", hdr_bucket(F.col("v")).alias("b")).select("v", "b", hdr_highest_equivalent(F.col("b"))).collect():
        c = min(max(v, 1), 3_600_000_000)
        assert b <= c <= top and top - b < max(1, c / 1000)


def test_roots_are_asked_by_their_base_name(spark):
    m = manifest(spark, FOO)
    walk = lambda **k: {r.rel_path: r.walk for r in filters.apply_filter(m, filters.FilterSettings.of(**k)).collect()}
    out = walk(exclude=["foo*/", "x"], root_name="foo1")
    assert out.pop("") == "skipped" and set(out.values()) == {"pruned"}
    assert walk(exclude=["foo*/", "x"], root_name="bar")["0.txt"] == "included"
    # Anchored and path patterns do not ask the root; a root directory is entered for what includes may find in it.
    assert walk(exclude=["/foo1", "foo1/bar"], root_name="foo1")[""] == "included"
    assert walk(include=["*.txt"], root_name="foo1")["0.txt"] == "included"


def test_pruning_agrees_with_asking_every_ancestor(spark):
    """Whether a walk reaches a path, from the path alone and from the verdicts of the directories above it one by one."""
    leaves = ["a/b/c.txt", "a/bb/x.log", "b/a/c.txt", "b/x[1]/c.txt", "deep/er/a/b/z", "n\nl/a b/c", "a.b/c/d.e", "bar/a/a/a/q"]
    m = manifest(spark, {p: {} for p in leaves})
    kinds = {r.rel_path: r.kind for r in m.collect()}
    for include, exclude in [((), ("a",)), ((), ("/a/", "b?")), ((), ("**/a/b",)), ((), ("*.b/", "x\\[1\\]")), ((), ("**",)), ((), ("{er,bb}", "n*")), (("a/**", "/b/a/"), ()), (("deep/er/a/",), ("z",)), (("*.txt", "a/b/**"), ("a/bb",)), (("**/q",), ("a/a",))]:
        settings = filters.FilterSettings.of(include, exclude)
        verdict = {r.rel_path: r.ok for r in m.select("rel_path", filters.is_included(settings, F.col("rel_path"), F.col("kind") == "dir").alias("ok")).collect()}
        want = {}
        for p, kind in kinds.items():
            up = ["/".join(p.split("/")[:k]) for k in range(1, p.count("/") + 1)]
            want[p] = "pruned" if p and not all(verdict[a] for a in up) else "included" if not p or verdict[p] else "skipped"
        assert {r.rel_path: r.walk for r in filters.apply_filter(m, settings).collect()} == want, (include, exclude)
