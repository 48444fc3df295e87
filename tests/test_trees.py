import random
import re

import pytest

from fileledger.functions import filters
from fileledger.functions.filters import FilterSettings
from fileledger.functions.metadata import parse_preserve
from fileledger.operators import plans, reports
from fileledger.operators.compare import compare, compare_summary, format_diff
from fileledger.operators.removal import rm_plan, rm_summary
from fileledger.sources.manifests import generate_tree, generated_summary, read_manifest, scan_files
from tests.conftest import FOO, manifest


def summary(df):
    return df.first().asDict()


def some(got, **want):
    assert {k: got[k] for k in want} == want


def without(rows, *names):
    return {k: v for k, v in rows.items() if k not in names}


def test_compare_golden(spark):
    dst = without(FOO, "bar/1.txt", "bar/2.txt") | {"baz/4.txt": {"size": 0}, "baz/7.txt": {"kind": "file", "size": 0}, "bar": {"kind": "dir", "mtime_s": 7}, "baz": {"kind": "dir", "mtime_s": 7}}
    dst["bar"]["size"] = dst["baz"]["size"] = 4096
    got = summary(compare_summary(compare(manifest(spark, FOO), manifest(spark, dst), "f:size,mtime d:mtime l:mtime")))
    some(got, file_different=1, file_same=2, file_dst_missing=2, file_src_missing=1, dir_different=2, dir_same=1, symlink_same=2, exit_code=1)


def test_compare_filters(spark):
    foo = manifest(spark, FOO)
    some(summary(compare_summary(compare(foo, foo, filter=FilterSettings.of(exclude=["bar/"])))), file_same=2, symlink_same=2, dir_skipped=2, exit_code=0)
    some(summary(compare_summary(compare(foo, foo, filter=FilterSettings.of(["**/*.txt"], ["bar/2.txt"])))), file_same=4, file_skipped=2)


def test_compare_expand(spark):
    some(summary(compare_summary(compare(manifest(spark, FOO), manifest(spark, {k: v for k, v in FOO.items() if not k.startswith("bar")}), expand_missing=True))), dir_dst_missing=1, file_dst_missing=3)
    some(summary(compare_summary(compare(manifest(spark, {"a/b/c/d.txt": {}, "a/b/mid.txt": {}}), manifest(spark, {"": {"kind": "dir", "size": 4096}}), expand_missing=True))), dir_dst_missing=3, file_dst_missing=2, src_bytes=2)


def test_diff_lines(spark):
    d = compare(manifest(spark, {"a\\b": {}}), manifest(spark, {"": {"kind": "dir"}}))
    assert [r.value for r in format_diff(d, "/s", "/d").collect()] == ['{"result":"dst_missing","src_type":"file","src":"/s/a\\\\\\\\b","dst_type":null,"dst":null}']
    assert [r.value for r in format_diff(d, "/s", "/d", "text").collect()] == ['[dst_missing] file "/s/a\\\\b" -']


def random_tree(rng, n):
    rows = {}
    dirs = [""]
    for _ in range(n):
        up = rng.choice(dirs)
        name = rng.choice(["a", "b", "x1", "x2", "k.log", "m.txt", "n.tmp", "d"]) + rng.choice(["", "0", "1"])
        path = f"{up}/{name}" if up else name
        if path in rows:
            continue
        kind = rng.choice(["file", "file", "dir", "dir", "symlink", "other"])
        rows[path] = {"kind": kind, "size": rng.randint(0, 2), "mtime_s": rng.choice([50, 100, 150]), "btime_s": None}
        if kind == "dir":
            dirs.append(path)
    return rows


def children(rows, path):
    return sorted(p for p in rows if p and p.rpartition("/")[0] == path)


def verdict(settings, path, is_dir):
    def hit(p):
        regex = filters.glob_regex(p.glob)
        found = re.fullmatch(regex, path) or (not p.anchored and not p.is_path and re.fullmatch(regex, path.rpartition("/")[2]))
        return bool(found) and (is_dir or not p.dir_only)

    if any(map(hit, settings.exclude)):
        return False, False
    direct = any(map(hit, settings.include)) or not settings.include
    return direct or is_dir, direct


SETTINGS = [FilterSettings(), FilterSettings.of(exclude=["x1/", "*.log*"]), FilterSettings.of(["*.txt*", "a/", "x2*"], ["b0/"])]


@pytest.mark.parametrize("k", range(3))
@pytest.mark.parametrize("expand", [False, True])
@pytest.mark.parametrize("early", [False, True])
def test_compare_against_recursion(spark, k, expand, early):
    rng = random.Random(100 + k)
    src = random_tree(rng, 260)
    dst = {p: (r | {"kind": rng.choice(["file", "dir"]), "size": 1} if rng.random() < 0.05 else r | {"mtime_s": r["mtime_s"] + (rng.random() < 0.2)}) for p, r in src.items() if rng.random() > 0.1}
    dst = {p: r for p, r in dst.items() if all(dst.get(a, {"kind": "dir"})["kind"] == "dir" and (a in dst) for a in ["/".join(p.split("/")[:i]) for i in range(1, len(p.split("/")))])}
    dst |= {f"only{i}/f{j}": {"kind": "file", "size": 1} for i in range(3) for j in range(2)}
    dst |= {f"only{i}": {"kind": "dir", "size": 4096} for i in range(3)}
    settings, want = SETTINGS[k], []
    full = lambda rows: {p: {"mtime_s": 100, "size": 1} | r for p, r in rows.items()} | {"": {"kind": "dir", "mtime_s": 100, "size": 4096}}
    s, d = full(src), full(dst)

    def one_sided(rows, path, result, side):
        want.append((path, result, side))
        if rows[path]["kind"] == "dir" and expand and not early:
            for c in children(rows, path):
                if verdict(settings, c, rows[c]["kind"] == "dir")[0]:
                    one_sided(rows, c, result, side)
                else:
                    want.append((c, "skipped", side))

    def both(path):
        a, b = s[path], d[path]
        equal = a["kind"] == b["kind"] and (a["kind"] == "other" or a["mtime_s"] == b["mtime_s"]) and (a["kind"] != "file" or a["size"] == b["size"])
        want.append((path, "same" if equal else "different", "both"))
        if a["kind"] != "dir" or b["kind"] != "dir" or (early and not equal):
            return
        seen = set()
        for c in children(s, path):
            if not verdict(settings, c, s[c]["kind"] == "dir")[0]:
                want.append((c, "skipped", "src"))
                continue
            seen.add(c)
            both(c) if c in d else one_sided(s, c, "dst_missing", "src")
        for c in children(d, path):
            if c not in seen:
                if verdict(settings, c, d[c]["kind"] == "dir")[0]:
                    one_sided(d, c, "src_missing", "dst")
                else:
                    want.append((c, "skipped", "dst"))

    both("")
    got = compare(manifest(spark, s), manifest(spark, d), filter=settings, expand_missing=expand, exit_early=early)
    assert sorted((r.rel_path, r.result, r.side) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("k", range(3))
@pytest.mark.parametrize("aged", [False, True])
def test_removal_against_recursion(spark, k, aged):
    rows = random_tree(random.Random(k), 300) | {"": {"kind": "dir", "mtime_s": 50, "size": 4096}}
    settings, gone = SETTINGS[k], set()
    old = lambda p: not aged or rows[p]["mtime_s"] <= 100

    def walk(path):
        """Whether path is gone, and whether anything was removed in it."""
        if rows[path]["kind"] != "dir":
            if old(path):
                gone.add(path)
            return path in gone, path in gone
        left = removed = False
        for c in children(rows, path):
            if not verdict(settings, c, rows[c]["kind"] == "dir")[0]:
                left = True
                continue
            a, b = walk(c)
            left, removed = left or not a, removed or b
        direct = verdict(settings, path, True)[1]
        if (direct or removed or not settings.include) and old(path) and not left:
            gone.add(path)
        return path in gone, removed or path in gone

    walk("")
    p = rm_plan(manifest(spark, rows), settings, modified_before="100s" if aged else None, now_s=200)
    assert {r.rel_path for r in p.where("action = 'remove'").collect()} == gone


def test_removal_golden(spark):
    foo = manifest(spark, FOO)
    some(summary(rm_summary(rm_plan(foo, FilterSettings.of(exclude=["bar/"])))), files_removed=2, symlinks_removed=2, directories_removed=1, directories_skipped=1)
    some(summary(rm_summary(rm_plan(foo, FilterSettings.of(["bar/*.txt"], ["bar/2.txt"])))), files_removed=2, files_skipped=2)
    m = manifest(spark, {"old.txt": {"mtime_s": 0}, "fresh/new": {"mtime_s": 7100}, "fresh/old": {"mtime_s": 0}, "fresh": {"kind": "dir", "mtime_s": 7100}})
    p = {r.rel_path: r.action for r in rm_plan(m, modified_before="3600s", now_s=7200).collect()}
    assert (p["old.txt"], p["fresh/old"], p["fresh/new"], p["fresh"]) == ("remove", "remove", "skip_time", "skip_time")


UPDATE = {"0.txt": {"size": 5}, "bar/1.txt": {"size": 5}, "bar/2.txt": {"kind": "symlink", "link_target": "../1.txt"}}


def test_link_golden(spark):
    foo, update = manifest(spark, FOO), manifest(spark, UPDATE)
    some(summary(plans.link_summary(plans.link_plan(foo))), hard_links_created=5, files_copied=0, symlinks_created=2, directories_created=3)
    some(summary(plans.link_summary(plans.link_plan(foo, update))), hard_links_created=2, files_copied=2, symlinks_created=3, directories_created=3)
    some(summary(plans.link_summary(plans.link_plan(foo, update, update_exclusive=True))), hard_links_created=0, files_copied=2, symlinks_created=1, directories_created=2)


def test_link_over_itself(spark):
    foo = manifest(spark, FOO)
    some(summary(plans.link_summary(plans.link_plan(foo, dst=foo, overwrite=True))), hard_links_created=0, hard_links_unchanged=5, errors=0)
    assert plans.link_plan(foo, dst=foo).where("action = 'error'").count() == 7


def test_copy_closure(spark):
    src = manifest(spark, {"a/f": {"size": 3}, "b": {"kind": "symlink", "link_target": "a"}, "c/d/e": {}})
    dst = manifest(spark, {"a": {"kind": "file"}, "b": {"kind": "symlink", "link_target": "z"}, "c/d": {"kind": "file"}, "keep": {}})
    keep = parse_preserve("all")
    plan = plans.copy_plan(src, dst, overwrite=True, preserve=keep)
    after = plans.apply_plan(src, dst, plan, keep)
    assert {r.rel_path for r in compare(src, after).where("result <> 'same'").collect()} == {"keep"}
    assert reports.validate_manifest(after).count() == 0
    assert plans.copy_plan(src, after, overwrite=True, preserve=keep).where("action not in ('unchanged', 'reuse_dir')").count() == 0


def test_delete_golden(spark):
    src, dst = manifest(spark, {"a.txt": {}}), manifest(spark, {"a.txt": {}, "extra/keep.log": {}, "extra/gone.txt": {}})
    log = FilterSettings.of(exclude=["*.log"])
    p = {r.rel_path: r.action for r in plans.mirror_delete_plan(src, dst, log).collect()}
    assert p == {"extra": "keep", "extra/keep.log": "skip_filter", "extra/gone.txt": "remove"}
    assert {r.action for r in plans.mirror_delete_plan(src, dst, log, delete_excluded=True).collect()} == {"remove"}
    failed = spark.createDataFrame([("a.txt",)], "rel_path string")
    assert plans.mirror_delete_plan(src, dst, log, errors=failed).count() == 0


@pytest.mark.parametrize(
    "widths, files, size, leaf, want",
    [([2], 3, 100, False, (9, 2, 900)), ([2, 3], 4, 50, False, (36, 8, 1800)), ([2, 3], 4, 50, True, (24, 8, 1200)), ([2, 2, 2], 2, 10, False, (30, 14, 300)), ([3, 2], 0, 10, False, (0, 9, 0))],
)
def test_generated_trees(spark, widths, files, size, leaf, want):
    m = generate_tree(spark, widths, files, size, leaf)
    assert tuple(generated_summary(m).first()) == want
    assert reports.validate_manifest(m).count() == 0


def test_sources(spark, tmp_path):
    spark.createDataFrame([("/data/x/", "dir", 0), ("/data/x/f", "file", 3), ("/other", "file", 1), ("/data", "dir", 0)], "path string, kind string, size bigint").write.parquet(str(tmp_path / "inv"))
    m = read_manifest(spark, str(tmp_path / "inv"), root="/data")
    assert sorted(r.rel_path for r in m.collect()) == ["", "x", "x/f"]
    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/one").write_bytes(b"abc")
    got = {(r.rel_path, r.kind, r.size) for r in scan_files(spark, str(tmp_path / "t"), str(tmp_path / "t")).collect()}
    assert got == {("", "dir", None), ("d", "dir", None), ("d/one", "file", 3)}


def test_plan_sink_orders_steps(spark, tmp_path):
    p = rm_plan(manifest(spark, {"a/b/c": {}}))
    reports.write_plan(p, str(tmp_path / "plan"), "post", files=1)
    assert [r.rel_path for r in spark.read.parquet(str(tmp_path / "plan")).collect()] == ["a/b/c", "a/b", "a", ""]


def test_empty_manifests(spark):
    none = manifest(spark, {"x": {}}).limit(0)
    assert compare(none, none).count() == 0 and rm_plan(none).count() == 0 and plans.copy_plan(none, none).count() == 0 and plans.link_plan(none).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_meet_once(spark):
    """Rows of both trees are joined once; what else is joined holds directories."""
    src, dst = manifest(spark, FOO), manifest(spark, FOO)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(compare(src, dst))
        assert plan.count("FullOuter") == 1 and plan.count("SortMergeJoin") == 3
        plan = plan_of(rm_plan(src, FilterSettings.of(include=["*.txt"])))
        assert plan.count("SortMergeJoin") == 1
        assert plan_of(plans.copy_plan(src, dst)).count("LeftOuter") == 1
        assert plan_of(plans.copy_plan(src, dst, overwrite=True)).count("SortMergeJoin") == 2
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
