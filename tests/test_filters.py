"""Lists of patterns against each pattern by itself."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fileledger.functions import filters
from fileledger.functions.filters import FilterSettings, apply_filter, glob_regex
from tests.conftest import manifest


def plain_match(p, path, is_dir):
    of = path if p.anchored or p.is_path else path.rsplit("/", 1)[-1]
    return (is_dir or not p.dir_only) and re.fullmatch(glob_regex(p.glob), of, re.S) is not None


def plain_verdict(settings, path, is_dir):
    for p in settings.exclude:
        if plain_match(p, path, is_dir):
            return "excluded_by_pattern", p.text
    if not settings.include or any(plain_match(p, path, is_dir) for p in settings.include):
        return "included", None

    def may_hold(p):
        prefix = p.literal_prefix
        return (not p.anchored and not p.is_path) or not prefix or path in ("", prefix) or path.startswith(prefix + "/") or prefix.startswith(path + "/")

    return ("included", None) if is_dir and any(map(may_hold, settings.include)) else ("excluded_by_default", None)


def plain_walk(settings, path, is_dir):
    if path == "":
        return "included", None
    up = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)]
    if any(plain_verdict(settings, a, True)[0] != "included" for a in up):
        return "pruned", None
    status, pattern = plain_verdict(settings, path, is_dir)
    return ("included", None) if status == "included" else ("skipped", pattern or "no include matches")


def random_pattern(rng):
    part = lambda: rng.choice(["a", "b", "ab", "a.txt", "b.log", "c", "*", "*.txt", "a*", "?", "[ab]", "{a,b}", "*b*", "a\\.txt", "x.y"])
    body = "/".join(part() for _ in range(rng.choice((1, 1, 1, 2, 3))))
    return rng.choice(("", "", "/")) + rng.choice(("", "", "", "**/")) + body + rng.choice(("", "", "", "/**", "/"))


@pytest.mark.parametrize("seed", range(4))
def test_lists_of_patterns_against_each_alone(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "ab", "a.txt", "b.log", "c", "xby", "ü.txt", "x.y", "a\nb"]
    rows = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(("", ".txt", "/f")): {} for _ in range(150)}
    m = manifest(spark, {p: v for p, v in rows.items() if not any(q.startswith(p + "/") for q in rows)})
    kinds = {r.rel_path: r.kind == "dir" for r in m.collect()}
    for _ in range(8):
        settings = FilterSettings.of([random_pattern(rng) for _ in range(rng.choice((0, 0, 1, 3, 80)))], [random_pattern(rng) for _ in range(rng.choice((0, 1, 4, 90)))])
        got = {r.rel_path: (r.walk, r.reason) for r in apply_filter(m, settings).collect()}
        assert got == {p: plain_walk(settings, p, d) for p, d in kinds.items()}, settings


def test_literal_patterns_need_no_regular_expression(spark):
    settings = FilterSettings.of(["src/**", "/top", "a/b"], ["x.txt", "*.log", "tmp*", "/a/b/c", "cache/", "old/**"])
    path = F.col("p")
    df = spark.createDataFrame([("a/b", True)], "p string, d boolean")
    plan = df.select(filters.filter_result(settings, path, F.col("d")), filters.excluded_above(settings, path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


@pytest.mark.parametrize("regular", [0, 300])
def test_ten_thousand_patterns(spark, regular):
    """Literal names, ends, paths and folders (and some globs) over many rows; the reason is the first that matches."""
    patterns = [x for i in range(2500) for x in (f"n{i}.txt", f"*.e{i}", f"/d{i % 50}/p{i}", f"d{i % 50}/s{i}/**")] + [f"g{i}*[xy]" for i in range(regular)]
    settings = FilterSettings.of(exclude=patterns)
    n = 200_000
    i = F.col("id")
    leaf = F.when(i % 4 == 0, F.concat(F.lit("n"), i % 5000, F.lit(".txt"))).when(i % 4 == 1, F.concat(F.lit("q.e"), i % 5000)).when(i % 4 == 2, F.concat(F.lit("p"), i % 5000)).otherwise(F.concat(F.lit("s"), i % 5000, F.lit("/f")))
    m = spark.range(n).select(F.concat(F.lit("d"), i % 5000 % 50, F.lit("/"), leaf).alias("rel_path"), F.lit("file").alias("kind"))
    began = time.time()
    got = {tuple(r): r["count"] for r in apply_filter(m, settings).groupBy("walk", "reason").count().collect()}
    took = time.time() - began
    walks = {}
    for (walk, reason, _), c in got.items():
        walks[walk] = walks.get(walk, 0) + c
        assert (reason is not None) == (walk == "skipped")
    half = sum(1 for k in range(n) if k % 5000 < 2500)
    assert walks["skipped"] + walks.get("pruned", 0) == half and took < 120
    assert {r for (w, r, _) in got if w == "skipped"} <= set(patterns)
