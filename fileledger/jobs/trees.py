"""Queries over trees: comparison, roll-ups, removal, permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fileledger.functions.filters import FilterSettings, apply_filter, time_filter
from fileledger.functions.metadata import iops_tokens, masked_mode, parse_preserve, project_preserved, tokens_beyond
from fileledger.jobs.entries import query
from fileledger.jobs.fixtures import DST_SQL, PARENT, SRC_SQL, UP, dst_manifest, src_manifest
from fileledger.operators import compare as cmp
from fileledger.operators.permissions import apply_permissions, chmod_plan, chmod_summary
from fileledger.operators.removal import rm_plan, rm_summary
from fileledger.operators.rollup import directory_rollup, top_k
from fileledger.sources.scratch import new_path
from fileledger.sources.stored import store_manifest, stored_manifest

NOW = 900_000_000
FILTER = FilterSettings.of(include=["p1/**", "*5.dat", "p3/sO/"], exclude=["c1?/", "/p2/sF", "*7.dat"])

_INC = "({p} LIKE 'p1/%' OR regexp_matches(regexp_extract({p}, '[^/]*$'), '^[^/]*5\\.dat$') OR ({p} = 'p3/sO' AND {d}))"
_EXC = "((regexp_matches(regexp_extract({p}, '[^/]*$'), '^c1[^/]$') AND {d}) OR {p} = 'p2/sF' OR regexp_matches(regexp_extract({p}, '[^/]*$'), '^[^/]*7\\.dat$'))"
#: Included: not excluded, and matched or a directory (an unanchored base-name include may match anywhere).
_OK = f"(NOT {_EXC} AND ({_INC} OR {{d}}))"


def _walk(t: str) -> str:
    """SQL of t with walk, dir-directly-matched and above (all directories above are entered)."""
    ok_dir = _OK.format(p="a", d="TRUE")
    return f"""{t}_w AS MATERIALIZED (
  SELECT *, CASE WHEN len(list_filter({UP.format(p='rel_path')}, lambda a: a <> '' AND NOT {ok_dir})) > 0 THEN 'pruned'
    WHEN rel_path = '' OR {_OK.format(p='rel_path', d="kind = 'dir'")} THEN 'included' ELSE 'skipped' END AS walk,
    {_INC.format(p='rel_path', d="kind = 'dir'")} AS direct FROM {t})"""


@query(
    "filtered_walk",
    f"""WITH {SRC_SQL}, {_walk('src')}
SELECT rel_path, kind, walk, CASE WHEN walk <> 'skipped' THEN NULL WHEN regexp_matches(regexp_extract(rel_path, '[^/]*$'), '^c1[^/]$') AND kind = 'dir' THEN 'c1?/'
  WHEN rel_path = 'p2/sF' THEN '/p2/sF' WHEN regexp_matches(rel_path, '7\\.dat$') THEN '*7.dat' ELSE 'no include matches' END AS reason FROM src_w""",
)
def filtered_walk(spark, sf_dir):
    return apply_filter(src_manifest(spark, sf_dir), FILTER).select("rel_path", "kind", "walk", "reason")


@query(
    "age_filter",
    f"""WITH {SRC_SQL}, a AS (SELECT rel_path, coalesce(mtime_s < {NOW - 30 * 86400} OR (mtime_s = {NOW - 30 * 86400} AND mtime_ns <= 0), FALSE) AS m,
  coalesce(btime_s < {NOW - 60 * 86400} OR btime_s = {NOW - 60 * 86400}, FALSE) AS c FROM src)
SELECT rel_path, CASE WHEN m AND c THEN 'matched' WHEN NOT m AND NOT c THEN 'too_new_both' WHEN NOT m THEN 'too_new_modified' ELSE 'too_new_created' END AS age FROM a""",
)
def age_filter(spark, sf_dir):
    return src_manifest(spark, sf_dir).select("rel_path", time_filter("30d", "60d", NOW).alias("age"))


_EQ = """CASE s.kind WHEN 'file' THEN s.mtime_s = d.mtime_s AND (s.mtime_ns = 0 OR d.mtime_ns = 0 OR s.mtime_ns = d.mtime_ns) AND s.size = d.size
  WHEN 'other' THEN TRUE ELSE s.mtime_s = d.mtime_s AND (s.mtime_ns = 0 OR d.mtime_ns = 0 OR s.mtime_ns = d.mtime_ns) END"""
_DIFF_ALL = f"""j AS MATERIALIZED (
  SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN d.rel_path IS NULL THEN 'dst_missing' WHEN s.rel_path IS NULL THEN 'src_missing' WHEN s.kind <> d.kind OR NOT ({_EQ}) THEN 'different' ELSE 'same' END AS result,
    s.kind AS src_kind, d.kind AS dst_kind, s.size AS src_size, d.size AS dst_size, CASE WHEN d.rel_path IS NULL THEN 'src' WHEN s.rel_path IS NULL THEN 'dst' ELSE 'both' END AS side
  FROM src s FULL JOIN dst d ON s.rel_path = d.rel_path), both_dirs AS (SELECT rel_path FROM j WHERE src_kind = 'dir' AND dst_kind = 'dir')"""
_DIFF = f"""{_DIFF_ALL}, diff AS MATERIALIZED (SELECT j.* FROM j LEFT JOIN both_dirs b ON b.rel_path = {PARENT.format(p='j.rel_path')} WHERE j.rel_path = '' OR b.rel_path IS NOT NULL)"""


@query("compare_trees", f"WITH {SRC_SQL}, {DST_SQL}, {_DIFF} SELECT * FROM diff")
def compare_trees(spark, sf_dir):
    return cmp.compare(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir))


@query("stored_compare", f"WITH {SRC_SQL}, {DST_SQL}, {_DIFF} SELECT * FROM diff")
def stored_compare(spark, sf_dir):
    """The same of manifests that are kept bucketed and sorted by path, and opened by where they lie."""
    kept = []
    for make in (src_manifest, dst_manifest):
        path = new_path(spark, "stored-manifest")
        store_manifest(make(spark, sf_dir), path, 16)
        kept.append(stored_manifest(spark, path, 16))
    return cmp.compare(*kept)


_FILTERED_DIFF = f"""{_walk('src')}, {_walk('dst')}, l AS (SELECT * FROM src_w WHERE walk = 'included'), j AS MATERIALIZED (
  SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN d.rel_path IS NULL THEN 'dst_missing' WHEN s.rel_path IS NULL THEN CASE d.walk WHEN 'included' THEN 'src_missing' WHEN 'skipped' THEN 'skipped' END WHEN s.kind <> d.kind OR NOT ({_EQ}) THEN 'different' ELSE 'same' END AS result,
    s.kind AS src_kind, d.kind AS dst_kind, s.size AS src_size, d.size AS dst_size, CASE WHEN d.rel_path IS NULL THEN 'src' WHEN s.rel_path IS NULL THEN 'dst' ELSE 'both' END AS side
  FROM l s FULL JOIN dst_w d ON s.rel_path = d.rel_path), both_dirs AS (SELECT rel_path FROM j WHERE src_kind = 'dir' AND dst_kind = 'dir'),
  rows AS (SELECT * FROM j WHERE result IS NOT NULL UNION ALL SELECT rel_path, 'skipped', kind, NULL, size, NULL, 'src' FROM src_w WHERE walk = 'skipped'),
  diff AS MATERIALIZED (SELECT r.* FROM rows r LEFT JOIN both_dirs b ON b.rel_path = {PARENT.format(p='r.rel_path')} WHERE r.rel_path = '' OR b.rel_path IS NOT NULL)"""


@query("compare_filtered", f"WITH {SRC_SQL}, {DST_SQL}, {_FILTERED_DIFF} SELECT * FROM diff")
def compare_filtered(spark, sf_dir):
    return cmp.compare(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), filter=FILTER)


@query(
    "compare_expanded",
    f"""WITH {SRC_SQL}, {DST_SQL}, {_DIFF_ALL}, blocked AS (SELECT rel_path FROM j WHERE side = 'both' AND src_kind <> dst_kind),
below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM j) x JOIN blocked b ON x.a = b.rel_path)
SELECT j.* FROM j ANTI JOIN below b ON j.rel_path = b.rel_path""",
)
def compare_expanded(spark, sf_dir):
    return cmp.compare(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), expand_missing=True)


@query(
    "compare_exit_early",
    f"""WITH {SRC_SQL}, {DST_SQL}, dst2 AS (SELECT * REPLACE (CASE WHEN kind = 'dir' AND regexp_matches(rel_path, '/c1[0-9]$') THEN mtime_s + 1 ELSE mtime_s END AS mtime_s) FROM dst), {_DIFF.replace("JOIN dst d", "JOIN dst2 d")},
odd AS (SELECT rel_path FROM j WHERE result = 'different' AND src_kind = 'dir'), below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM diff) x JOIN odd b ON x.a = b.rel_path)
SELECT d.* FROM diff d ANTI JOIN below b ON d.rel_path = b.rel_path""",
)
def compare_exit_early(spark, sf_dir):
    touched = (F.col("kind") == "dir") & F.col("rel_path").rlike("/c1[0-9]$")
    dst = dst_manifest(spark, sf_dir).withColumn("mtime_s", F.col("mtime_s") + F.when(touched, 1).otherwise(0))
    return cmp.compare(src_manifest(spark, sf_dir), dst, exit_early=True)


_SUMMARY = ", ".join(
    [f"count(*) FILTER (result = '{r}' AND coalesce(src_kind, dst_kind) = '{k}') AS {k}_{r}" for k in ("file", "dir", "symlink", "other") for r in cmp.RESULTS]
    + [f"count(*) FILTER (result = 'skipped' AND CASE coalesce(src_kind, dst_kind) WHEN 'other' THEN 'file' ELSE coalesce(src_kind, dst_kind) END = '{k}') AS {k}_skipped" for k in ("file", "dir", "symlink")]
    + [f"coalesce(sum({s}_size) FILTER (result <> 'skipped' AND {s}_kind = 'file'), 0)::BIGINT AS {s}_bytes" for s in ("src", "dst")]
    + ["max(CASE WHEN result IN ('different', 'src_missing', 'dst_missing') THEN 1 ELSE 0 END) AS exit_code"]
)


@query("compare_summary", f"WITH {SRC_SQL}, {DST_SQL}, {_DIFF} SELECT {_SUMMARY} FROM diff")
def compare_summary(spark, sf_dir):
    return cmp.compare_summary(compare_trees(spark, sf_dir))


@query("compare_filtered_summary", f"WITH {SRC_SQL}, {DST_SQL}, {_FILTERED_DIFF} SELECT {_SUMMARY} FROM diff")
def compare_filtered_summary(spark, sf_dir):
    return cmp.compare_summary(compare_filtered(spark, sf_dir))


def _json(kind: str, root: str) -> str:
    return f"CASE WHEN {kind} IS NULL THEN 'null' ELSE '\"' || '{root}' || CASE WHEN rel_path = '' THEN '' ELSE '/' || rel_path END || '\"' END"


@query(
    "diff_log",
    f"""WITH {SRC_SQL}, {DST_SQL}, {_DIFF} SELECT rel_path, '{{"result":"' || result || '","src_type":' || coalesce('"' || src_kind || '"', 'null') || ',"src":' || {_json('src_kind', '/a')}
  || ',"dst_type":' || coalesce('"' || dst_kind || '"', 'null') || ',"dst":' || {_json('dst_kind', '/b')} || '}}' AS value FROM diff WHERE result <> 'same'""",
)
def diff_log(spark, sf_dir):
    return cmp.format_diff(compare_trees(spark, sf_dir), "/a/", "/b")


@query("path_sets", f"WITH {SRC_SQL}, {DST_SQL} SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN 'added' WHEN d.rel_path IS NULL THEN 'removed' ELSE 'common' END AS status FROM src s FULL JOIN dst d ON s.rel_path = d.rel_path")
def path_sets(spark, sf_dir):
    return cmp.path_diff(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir))


@query(
    "tree_identity",
    f"""WITH {SRC_SQL}, {DST_SQL} SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN b.kind IS NULL THEN 'only in a' WHEN a.kind IS NULL THEN 'only in b' WHEN a.kind <> b.kind THEN 'kind'
  WHEN a.mode & 4095 <> b.mode & 4095 THEN 'mode' WHEN a.link_target IS DISTINCT FROM b.link_target THEN 'link_target' WHEN a.mtime_s <> b.mtime_s OR a.mtime_ns <> b.mtime_ns THEN 'mtime' END AS problem
FROM src a FULL JOIN dst b ON a.rel_path = b.rel_path WHERE problem IS NOT NULL""",
)
def tree_identity(spark, sf_dir):
    return cmp.trees_identical(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir))


_ROLLUP = f"""up AS (SELECT unnest(list_append({UP.format(p='rel_path')}, CASE WHEN kind = 'dir' AND rel_path <> '' THEN rel_path END)) AS d, kind, size FROM src),
rollup_ AS (SELECT d AS rel_path, coalesce(sum(size) FILTER (kind = 'file'), 0)::BIGINT AS bytes, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS dirs, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'other') AS others
  FROM up WHERE d IS NOT NULL GROUP BY d)"""


@query("directory_rollup", f"WITH {SRC_SQL}, {_ROLLUP} SELECT * FROM rollup_")
def directory_rollup_query(spark, sf_dir):
    return directory_rollup(src_manifest(spark, sf_dir))


@query("largest_subtrees", f"WITH {SRC_SQL}, {_ROLLUP} SELECT * FROM rollup_ ORDER BY bytes DESC, rel_path LIMIT 25")
def largest_subtrees(spark, sf_dir):
    return top_k(directory_rollup(src_manifest(spark, sf_dir)), "bytes", 25, "rel_path")


def _rm_sql(dry: bool) -> str:
    ok = f"(mtime_s < {NOW - 365 * 86400} OR (mtime_s = {NOW - 365 * 86400} AND mtime_ns <= 0))"
    up = f"list_append({UP.format(p='rel_path')}, CASE WHEN kind = 'dir' THEN rel_path END)"
    blockers = "walk = 'skipped' OR (walk = 'included' AND NOT ok)" if dry else "walk <> 'included' OR NOT ok OR (kind = 'dir' AND NOT is_seeded)"
    passed = "" if dry else "WHEN kind = 'dir' AND NOT direct AND NOT is_seeded THEN 'keep'"
    return f"""{SRC_SQL}, {_walk('src')}, r0 AS (SELECT rel_path, kind, size, walk, direct, {ok} AS ok FROM src_w),
seeded AS (SELECT DISTINCT unnest({up}) AS d FROM r0 WHERE walk = 'included' AND CASE WHEN kind = 'dir' THEN direct ELSE ok END),
r1 AS (SELECT *, rel_path IN (SELECT d FROM seeded WHERE d IS NOT NULL) AS is_seeded FROM r0),
stays AS (SELECT DISTINCT unnest({up}) AS d FROM r1 WHERE {blockers}),
plan AS (SELECT rel_path, kind, size, CASE WHEN walk = 'pruned' THEN 'pruned' WHEN walk = 'skipped' THEN 'skip_filter'
  WHEN CASE WHEN kind = 'dir' THEN rel_path NOT IN (SELECT d FROM stays WHERE d IS NOT NULL) AND ok AND is_seeded ELSE ok END THEN 'remove' {passed} WHEN NOT ok THEN 'skip_time' ELSE 'keep' END AS action FROM r1)"""


@query("rm_plan", f"WITH {_rm_sql(False)} SELECT * FROM plan")
def rm_plan_query(spark, sf_dir):
    return rm_plan(src_manifest(spark, sf_dir), FILTER, modified_before="365d", now_s=NOW).drop("reason")


@query("rm_dry_run", f"WITH {_rm_sql(True)} SELECT * FROM plan")
def rm_dry_run(spark, sf_dir):
    return rm_plan(src_manifest(spark, sf_dir), FILTER, modified_before="365d", now_s=NOW, dry_run=True).drop("reason")


_RM_SUM = ", ".join(
    ["coalesce(sum(size) FILTER (action = 'remove' AND kind IN ('file', 'other')), 0)::BIGINT AS bytes_removed"]
    + [f"count(*) FILTER (action {a} AND CASE kind WHEN 'other' THEN 'file' ELSE kind END = '{k}') AS {n}_{w}" for w, a in (("removed", "= 'remove'"), ("skipped", "IN ('skip_filter', 'skip_time')")) for k, n in (("file", "files"), ("dir", "directories"), ("symlink", "symlinks"))]
)


@query("rm_summary", f"WITH {_rm_sql(False)} SELECT {_RM_SUM} FROM plan")
def rm_summary_query(spark, sf_dir):
    return rm_summary(rm_plan_query(spark, sf_dir))


_CHMOD = f"""{SRC_SQL}, {_walk('src')}, c0 AS (SELECT *, mode & 4095 AS o, kind = 'dir' AS d FROM src_w),
c1 AS (SELECT *, CASE WHEN kind IN ('file', 'dir') THEN (o | 16) | CASE WHEN d OR (o | 16) & 73 <> 0 THEN 8 ELSE 0 END ELSE o END AS t0 FROM c0),
c2 AS (SELECT *, CASE WHEN kind IN ('file', 'dir') THEN t0 & ~519 ELSE o END AS w, CASE WHEN uid <> 1003 THEN 1003 END AS nu, CASE WHEN gid <> 101 AND kind = 'file' THEN 101 END AS ng FROM c1),
c3 AS (SELECT *, nu IS NOT NULL OR ng IS NOT NULL AS ch, CASE WHEN kind <> 'symlink' AND (w <> o OR ((nu IS NOT NULL OR ng IS NOT NULL) AND w & 3072 <> 0)) THEN w END AS cm FROM c2),
plan AS (SELECT rel_path, kind, CASE WHEN walk = 'pruned' THEN 'pruned' WHEN walk = 'skipped' THEN 'skip_filter' WHEN d AND NOT direct THEN 'traverse' WHEN ch OR cm IS NOT NULL THEN 'change' ELSE 'unchanged' END AS action,
  CASE WHEN action = 'change' THEN nu END::BIGINT AS chown_uid, CASE WHEN action = 'change' THEN ng END::BIGINT AS chown_gid, CASE WHEN action = 'change' THEN cm END AS chmod FROM c3)"""


@query("chmod_plan", f"WITH {_CHMOD} SELECT * FROM plan")
def chmod_plan_query(spark, sf_dir):
    p = chmod_plan(src_manifest(spark, sf_dir), mode="g+wX,o=", owner="1003", group="f:101", filter=FILTER)
    return p.select("rel_path", "kind", "action", "chown_uid", "chown_gid", F.col("chmod").cast("int").alias("chmod"))


@query(
    "chmod_closure",
    f"""WITH {_CHMOD} SELECT s.rel_path, coalesce(p.chown_uid, s.uid)::BIGINT AS uid, coalesce(p.chown_gid, s.gid)::BIGINT AS gid, CASE WHEN p.chmod IS NOT NULL THEN (s.mode & ~4095) | p.chmod WHEN (p.chown_uid IS NOT NULL OR p.chown_gid IS NOT NULL) AND s.kind IN ('file', 'other') THEN s.mode & ~3072 ELSE s.mode END::INT AS mode
FROM src s JOIN plan p ON s.rel_path = p.rel_path""",
)
def chmod_closure(spark, sf_dir):
    """The source's manifest after the chmod plan."""
    m = src_manifest(spark, sf_dir)
    return apply_permissions(m, chmod_plan_query(spark, sf_dir)).select("rel_path", "uid", "gid", "mode")


_CHMOD_SUM = ", ".join(f"count(*) FILTER (action {a} AND CASE kind WHEN 'other' THEN 'file' ELSE kind END = '{k}') AS {n}_{w}" for w, a in (("changed", "= 'change'"), ("unchanged", "= 'unchanged'"), ("skipped", "= 'skip_filter'")) for k, n in (("file", "files"), ("dir", "directories"), ("symlink", "symlinks")))


@query("chmod_summary", f"WITH {_CHMOD} SELECT {_CHMOD_SUM} FROM plan")
def chmod_summary_query(spark, sf_dir):
    return chmod_summary(chmod_plan_query(spark, sf_dir))


@query(
    "preserve_projection",
    f"""WITH {SRC_SQL} SELECT rel_path, CASE WHEN kind = 'file' THEN uid ELSE 12 END::BIGINT AS uid, CASE WHEN kind = 'dir' THEN gid ELSE 34 END::BIGINT AS gid,
  CASE WHEN kind IN ('file', 'symlink') THEN mtime_s ELSE {NOW} END::BIGINT AS mtime_s, CASE WHEN kind = 'file' THEN mode & 4095 & 488 ELSE mode & 511 END AS mode FROM src""",
)
def preserve_projection(spark, sf_dir):
    return project_preserved(src_manifest(spark, sf_dir), parse_preserve("f:uid,time,0750 d:gid l:time"), uid=12, gid=34, now_s=NOW).select("rel_path", "uid", "gid", "mtime_s", "mode")


@query("io_tokens", f"WITH {SRC_SQL} SELECT rel_path, (1 + (greatest(1, size) - 1) // 65536)::BIGINT AS tokens, mode & 4095 AS perm, (1 + greatest(1, size * 1000) - 1)::BIGINT AS small_chunk, greatest(1, size * 1000) > 4294967295 AS beyond FROM src WHERE kind = 'file'")
def io_tokens(spark, sf_dir):
    small = iops_tokens(F.col("size") * 1000, 1)
    return src_manifest(spark, sf_dir).where("kind = 'file'").select("rel_path", iops_tokens(F.col("size"), 65536).alias("tokens"), masked_mode(F.col("mode")).alias("perm"), small.alias("small_chunk"), tokens_beyond(small).alias("beyond"))
