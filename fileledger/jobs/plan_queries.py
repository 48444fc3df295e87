"""Queries over plans: copy, mirror, link, and what is reported of them."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fileledger.functions.filters import FilterSettings
from fileledger.functions.metadata import parse_preserve
from fileledger.functions.paths import parent
from fileledger.jobs.entries import query
from fileledger.jobs.fixtures import DST_SQL, PARENT, SAMPLES_SQL, SRC_SQL, UP, UPD_SQL, document_manifest, dst_manifest, errors, samples, src_manifest, table, update_manifest
from fileledger.jobs.trees import FILTER, _walk
from fileledger.operators import plans, reports
from fileledger.operators.compare import compare
from fileledger.operators.policy import Rule
from fileledger.operators.rollup import directory_rollup

BOTH = f"{SRC_SQL}, {DST_SQL}"
_MT = "(s.mtime_s = d.mtime_s AND (s.mtime_ns = 0 OR d.mtime_ns = 0 OR s.mtime_ns = d.mtime_ns))"


def _action(clash: str, mkdir: str = "mkdir") -> str:
    return f"""CASE s.kind WHEN 'dir' THEN CASE WHEN d.kind IS NULL THEN '{mkdir}' WHEN d.kind = 'dir' THEN 'reuse_dir' ELSE '{clash}' END
  WHEN 'file' THEN CASE WHEN d.kind IS NULL THEN 'copy' WHEN {'FALSE' if clash == 'error' else f"d.kind = 'file' AND s.size = d.size AND {_MT}"} THEN 'unchanged' ELSE '{clash}' END
  WHEN 'symlink' THEN CASE WHEN d.kind IS NULL THEN 'symlink' WHEN {'FALSE' if clash == 'error' else "d.kind = 'symlink' AND s.link_target IS NOT DISTINCT FROM d.link_target"} THEN 'unchanged' ELSE '{clash}' END
  ELSE 'skip_special' END"""


def _removed(plan: str) -> str:
    return f"""gone AS (SELECT x.a AS rel_path, count(*) FILTER (x.kind IN ('file', 'other')) AS f, count(*) FILTER (x.kind = 'dir') AS dd, count(*) FILTER (x.kind = 'symlink') AS l, coalesce(sum(x.size) FILTER (x.kind IN ('file', 'other')), 0)::BIGINT AS b
  FROM (SELECT kind, size, unnest(list_append({UP.format(p='rel_path')}, rel_path)) AS a FROM dst) x JOIN (SELECT rel_path FROM {plan} WHERE action = 'replace') r ON x.a = r.rel_path GROUP BY 1),
plan AS (SELECT p.rel_path, p.kind, p.size, p.action, p.dst_kind, coalesce(g.f, 0) AS removed_files, coalesce(g.dd, 0) AS removed_dirs, coalesce(g.l, 0) AS removed_symlinks, coalesce(g.b, 0)::BIGINT AS removed_bytes FROM {plan} p LEFT JOIN gone g ON p.rel_path = g.rel_path)"""


_COPY = f"{BOTH}, p0 AS (SELECT s.rel_path, s.kind, s.size, {_action('replace')} AS action, d.kind AS dst_kind FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path), {_removed('p0')}"


@query("copy_plan", f"WITH {_COPY} SELECT * FROM plan")
def copy_plan(spark, sf_dir):
    return plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), overwrite=True, skip_specials=True).drop("reason")


@query(
    "copy_plan_strict",
    f"""WITH {BOTH}, p0 AS MATERIALIZED (SELECT s.rel_path, s.kind, s.size, {_action('error')} AS action, d.kind AS dst_kind FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path),
blocked AS (SELECT rel_path FROM p0 WHERE kind = 'dir' AND action = 'error'), below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM p0) x JOIN blocked b ON x.a = b.rel_path)
SELECT p.* FROM p0 p ANTI JOIN below b ON p.rel_path = b.rel_path""",
)
def copy_plan_strict(spark, sf_dir):
    return plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), skip_specials=True).select("rel_path", "kind", "size", "action", "dst_kind")


_NEWER = "(d.kind = 'file' AND (d.mtime_s > s.mtime_s OR (d.mtime_s = s.mtime_s AND d.mtime_ns > s.mtime_ns)))"


@query("copy_plan_keep_newer", f"WITH {BOTH} SELECT s.rel_path, CASE WHEN s.kind = 'file' AND d.kind IS NOT NULL AND {_NEWER} THEN 'unchanged' ELSE {_action('replace')} END AS action FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path")
def copy_plan_keep_newer(spark, sf_dir):
    return plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), overwrite=True, keep_newer=True, skip_specials=True).select("rel_path", "action")


_COPY_FILTERED = f"""{SRC_SQL}, {DST_SQL}, dst_few AS (SELECT * FROM dst WHERE rel_path NOT LIKE 'p4%'), {_walk('src')}, p0 AS MATERIALIZED (
  SELECT s.rel_path, s.kind, s.size, {_action('replace')} AS action, s.direct FROM src_w s LEFT JOIN dst_few d ON s.rel_path = d.rel_path WHERE s.walk = 'included'
  UNION ALL SELECT rel_path, kind, size, 'skip_filter', direct FROM src_w WHERE walk = 'skipped'),
seeds AS (SELECT CASE WHEN kind = 'dir' THEN rel_path ELSE {PARENT.format(p='rel_path')} END AS f FROM p0 WHERE (kind <> 'dir' AND action IN ('copy', 'replace', 'symlink')) OR (kind = 'dir' AND action IN ('mkdir', 'replace') AND direct)),
kept AS MATERIALIZED (SELECT DISTINCT unnest(list_append({UP.format(p='f')}, f)) AS d FROM seeds),
plan AS (SELECT p.rel_path, kind, size, CASE WHEN kind = 'dir' AND action IN ('mkdir', 'replace') AND p.rel_path <> '' AND NOT direct AND k.d IS NULL THEN 'drop_empty_dir' ELSE action END AS action FROM p0 p LEFT JOIN kept k ON k.d = p.rel_path)"""


@query("copy_plan_filtered", f"WITH {_COPY_FILTERED} SELECT * FROM plan")
def copy_plan_filtered(spark, sf_dir):
    dst = dst_manifest(spark, sf_dir).where("rel_path not like 'p4%'")
    return plans.copy_plan(src_manifest(spark, sf_dir), dst, overwrite=True, skip_specials=True, filter=FILTER).select("rel_path", "kind", "size", "action")


@query(
    "copy_dry_run",
    f"""WITH {BOTH}, blocked AS (SELECT a.rel_path FROM src a JOIN dst b ON a.rel_path = b.rel_path WHERE a.kind = 'dir' AND b.kind <> 'dir'),
below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM src) x JOIN blocked b ON x.a = b.rel_path)
SELECT s.rel_path, s.kind, s.size, CASE s.kind WHEN 'dir' THEN CASE WHEN d.kind <> 'dir' THEN 'skip_existing' ELSE 'mkdir' END WHEN 'other' THEN 'skip_special'
  WHEN 'file' THEN CASE WHEN d.kind IS NULL THEN 'copy' ELSE 'unchanged' END ELSE CASE WHEN d.kind IS NULL THEN 'symlink' ELSE 'unchanged' END END AS action
FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path ANTI JOIN below x ON s.rel_path = x.rel_path""",
)
def copy_dry_run(spark, sf_dir):
    return plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), ignore_existing=True, skip_specials=True, dry_run=True).select("rel_path", "kind", "size", "action")


@query(
    "copy_summary",
    f"""WITH {_COPY} SELECT coalesce(sum(size) FILTER (action IN ('copy', 'replace') AND kind = 'file'), 0)::BIGINT AS bytes_copied, count(*) FILTER (action IN ('copy', 'replace') AND kind = 'file') AS files_copied,
  count(*) FILTER (kind = 'file' AND action = 'unchanged') AS files_unchanged, count(*) FILTER (kind = 'symlink' AND action IN ('symlink', 'replace')) AS symlinks_created, count(*) FILTER (kind = 'symlink' AND action = 'unchanged') AS symlinks_unchanged,
  count(*) FILTER (kind = 'dir' AND action IN ('mkdir', 'replace')) AS directories_created, count(*) FILTER (kind = 'dir' AND action = 'reuse_dir') AS directories_unchanged, 0::BIGINT AS files_skipped, 0::BIGINT AS directories_skipped, 0::BIGINT AS symlinks_skipped,
  count(*) FILTER (action = 'skip_special') AS specials_skipped, 0::BIGINT AS errors, sum(removed_bytes)::BIGINT AS removed_bytes, sum(removed_files)::BIGINT AS removed_files, sum(removed_symlinks)::BIGINT AS removed_symlinks, sum(removed_dirs)::BIGINT AS removed_dirs FROM plan""",
)
def copy_summary(spark, sf_dir):
    return plans.copy_summary(copy_plan(spark, sf_dir))


_EXCLUDED = "regexp_matches(rel_path, '(^|/)x1[^/]*\\.log$')"
_DELETE = f"""{BOTH}, tops AS (SELECT d.* FROM dst d WHERE {PARENT.format(p='d.rel_path')} IN (SELECT s.rel_path FROM src s JOIN dst e ON s.rel_path = e.rel_path WHERE s.kind = 'dir' AND e.kind = 'dir') AND d.rel_path NOT IN (SELECT rel_path FROM src) AND NOT {_EXCLUDED.replace('rel_path', 'd.rel_path')}),
rws AS (SELECT * FROM tops UNION SELECT d.* FROM dst d JOIN tops t ON t.kind = 'dir' AND starts_with(d.rel_path, t.rel_path || '/')),
plan AS (SELECT rel_path, kind, size, CASE WHEN {_EXCLUDED} THEN 'skip_filter' WHEN kind = 'dir' AND EXISTS (SELECT 1 FROM rws x WHERE starts_with(x.rel_path, r.rel_path || '/') AND {_EXCLUDED.replace('rel_path', 'x.rel_path')}) THEN 'keep' ELSE 'remove' END AS action FROM rws r)"""


@query("mirror_delete", f"WITH {_DELETE} SELECT * FROM plan")
def mirror_delete(spark, sf_dir):
    return plans.mirror_delete_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), FilterSettings.of(exclude=["x1*.log"])).drop("reason")


@query("mirror_closure", f"WITH {_DELETE} SELECT d.rel_path, d.kind FROM dst d ANTI JOIN (SELECT rel_path FROM plan WHERE action = 'remove') p ON d.rel_path = p.rel_path")
def mirror_closure(spark, sf_dir):
    """What a mirror's delete pass leaves of the destination."""
    return plans.apply_removals(dst_manifest(spark, sf_dir), mirror_delete(spark, sf_dir)).select("rel_path", "kind")


@query(
    "mirror_delete_errors",
    f"""WITH {BOTH}, failed AS (SELECT rel_path FROM src WHERE kind = 'file' AND regexp_matches(rel_path, '/o[0-9]*55[.]dat$')), exempt AS MATERIALIZED (SELECT DISTINCT unnest(list_append({UP.format(p='rel_path')}, rel_path)) AS d FROM failed),
shared AS (SELECT s.rel_path FROM src s JOIN dst e ON s.rel_path = e.rel_path ANTI JOIN exempt x ON s.rel_path = x.d WHERE s.kind = 'dir' AND e.kind = 'dir'),
tops AS MATERIALIZED (SELECT d.* FROM dst d JOIN shared h ON {PARENT.format(p='d.rel_path')} = h.rel_path ANTI JOIN src s ON d.rel_path = s.rel_path),
below AS (SELECT DISTINCT x.rel_path, x.kind, x.size FROM (SELECT rel_path, kind, size, unnest(list_append({UP.format(p='rel_path')}, rel_path)) AS a FROM dst) x JOIN tops t ON x.a = t.rel_path)
SELECT rel_path, kind, size, 'remove' AS action FROM below""",
)
def mirror_delete_errors(spark, sf_dir):
    """Directories with an error at or below them keep what they have."""
    src = src_manifest(spark, sf_dir)
    failed = src.where("kind = 'file' and rel_path rlike '/o[0-9]*55[.]dat$'")
    return plans.mirror_delete_plan(src, dst_manifest(spark, sf_dir), errors=failed).drop("reason")


_LINK = f"""{SRC_SQL}, {UPD_SQL}, j AS MATERIALIZED (SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, s.kind AS sk, d.kind AS uk, s.size AS ss, d.size AS us,
  CASE WHEN d.kind IS NULL THEN CASE s.kind WHEN 'dir' THEN 'mkdir' WHEN 'file' THEN 'hardlink' WHEN 'symlink' THEN 'symlink' ELSE 'skip_special' END
    WHEN s.kind = 'file' AND d.kind = 'file' AND s.size = d.size AND {_MT} THEN 'hardlink'
    ELSE CASE d.kind WHEN 'dir' THEN 'mkdir' WHEN 'file' THEN 'copy_from_update' WHEN 'symlink' THEN 'symlink' ELSE 'skip_special' END END AS action FROM src s FULL JOIN upd d ON s.rel_path = d.rel_path),
swapped AS (SELECT rel_path FROM j WHERE sk <> uk), below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM j WHERE uk IS NULL) x JOIN swapped b ON x.a = b.rel_path),
plan AS (SELECT rel_path, CASE WHEN uk IS NOT NULL AND NOT (action = 'hardlink' AND sk IS NOT NULL) THEN uk ELSE sk END AS kind, CASE WHEN uk IS NOT NULL AND NOT (action = 'hardlink' AND sk IS NOT NULL) THEN us ELSE ss END AS size, action,
  CASE WHEN uk IS NOT NULL AND NOT (action = 'hardlink' AND sk IS NOT NULL) THEN 'update' ELSE 'src' END AS origin FROM j ANTI JOIN below b ON j.rel_path = b.rel_path)"""


@query("link_plan", f"WITH {_LINK} SELECT * FROM plan")
def link_plan(spark, sf_dir):
    return _link_plan(spark, sf_dir).select("rel_path", "kind", "size", "action", "origin")


def _link_plan(spark, sf_dir):
    return plans.link_plan(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), skip_specials=True)


@query(
    "link_summary",
    f"""WITH {_LINK} SELECT count(*) FILTER (action = 'hardlink') AS hard_links_created, 0::BIGINT AS hard_links_unchanged, count(*) FILTER (action = 'copy_from_update') AS files_copied, coalesce(sum(size) FILTER (action = 'copy_from_update'), 0)::BIGINT AS bytes_copied,
  0::BIGINT AS files_unchanged, count(*) FILTER (action = 'symlink') AS symlinks_created, 0::BIGINT AS symlinks_unchanged, count(*) FILTER (action = 'mkdir') AS directories_created, 0::BIGINT AS directories_unchanged, count(*) FILTER (action = 'skip_special') AS specials_skipped, 0::BIGINT AS errors,
  0::BIGINT AS removed_files, 0::BIGINT AS removed_dirs, 0::BIGINT AS removed_symlinks, 0::BIGINT AS removed_bytes FROM plan""",
)
def link_summary(spark, sf_dir):
    return plans.link_summary(_link_plan(spark, sf_dir))


def _onto_sql(overwrite: bool) -> str:
    """SQL of a link run onto the destination, in which paths that end in 1.dat are links of the source already."""
    clash = "'replace'" if overwrite else "'error'"
    act = f"""CASE WHEN d.kind IS NULL OR w.want IN ('skip_special') THEN CASE w.want WHEN 'dir' THEN 'mkdir' ELSE w.want END
      WHEN w.want = 'dir' THEN CASE WHEN d.kind = 'dir' THEN 'reuse_dir' ELSE {clash} END
      WHEN w.want = 'hardlink' THEN {"CASE WHEN d.kind = w.sk AND d.dev = w.dev AND d.ino = w.ino THEN 'link_unchanged' ELSE 'relink' END" if overwrite else "'error'"}
      WHEN w.want = 'copy_from_update' THEN {"CASE WHEN d.kind = 'file' AND w.us = d.size AND w.ut = d.mtime_s AND (w.un = 0 OR d.mtime_ns = 0 OR w.un = d.mtime_ns) THEN 'unchanged' ELSE 'replace' END" if overwrite else "'error'"}
      ELSE {"CASE WHEN d.kind = 'symlink' AND w.target IS NOT DISTINCT FROM d.link_target THEN 'unchanged' ELSE 'replace' END" if overwrite else "'error'"} END"""
    out = "rel_path, kind, size, action, origin, dst_kind"
    return f"""{SRC_SQL}, {UPD_SQL}, {DST_SQL}, onto AS MATERIALIZED (SELECT * REPLACE (CASE WHEN rel_path LIKE '%1.dat' THEN ino - 1000000000 ELSE ino END AS ino) FROM dst),
w0 AS (SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, s.kind AS sk, d.kind AS uk, s.size AS ss, d.size AS us, d.mtime_s AS ut, d.mtime_ns AS un, s.dev, s.ino, s.link_target AS st, d.link_target AS ult,
  CASE WHEN d.kind IS NULL THEN CASE s.kind WHEN 'dir' THEN 'dir' WHEN 'file' THEN 'hardlink' WHEN 'symlink' THEN 'symlink' ELSE 'skip_special' END
    WHEN s.kind = 'file' AND d.kind = 'file' AND s.size = d.size AND {_MT} THEN 'hardlink'
    ELSE CASE d.kind WHEN 'dir' THEN 'dir' WHEN 'file' THEN 'copy_from_update' WHEN 'symlink' THEN 'symlink' ELSE 'skip_special' END END AS want FROM src s FULL JOIN upd d ON s.rel_path = d.rel_path),
w AS MATERIALIZED (SELECT *, uk IS NOT NULL AND NOT (want = 'hardlink' AND sk IS NOT NULL) AS of_update, CASE WHEN of_update THEN ult ELSE st END AS target FROM w0),
j AS MATERIALIZED (SELECT w.rel_path, CASE WHEN of_update THEN w.uk ELSE w.sk END AS kind, CASE WHEN of_update THEN w.us ELSE w.ss END AS size, {act} AS action, CASE WHEN of_update THEN 'update' ELSE 'src' END AS origin, d.kind AS dst_kind, d.size AS ds, w.want FROM w LEFT JOIN onto d ON w.rel_path = d.rel_path),
stopped AS (SELECT rel_path FROM w WHERE sk = 'dir' AND uk <> 'dir' UNION SELECT rel_path FROM j WHERE want = 'dir' AND action = 'error'),
below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM j) x JOIN stopped b ON x.a = b.rel_path),
p0 AS MATERIALIZED (SELECT j.* FROM j ANTI JOIN below b ON j.rel_path = b.rel_path),
gone AS (SELECT x.a AS rel_path, count(*) FILTER (x.kind IN ('file', 'other')) AS f, count(*) FILTER (x.kind = 'dir') AS dd, count(*) FILTER (x.kind = 'symlink') AS l, coalesce(sum(x.size) FILTER (x.kind IN ('file', 'other')), 0)::BIGINT AS b
  FROM (SELECT kind, size, unnest(list_append({UP.format(p='rel_path')}, rel_path)) AS a FROM onto) x JOIN (SELECT rel_path FROM p0 WHERE action IN ('replace', 'relink')) r ON x.a = r.rel_path GROUP BY 1),
plan AS (SELECT {out.replace("rel_path", "p.rel_path")}, coalesce(g.f, 0)::BIGINT AS removed_files, coalesce(g.dd, 0)::BIGINT AS removed_dirs, coalesce(g.l, 0)::BIGINT AS removed_symlinks, coalesce(g.b, 0)::BIGINT AS removed_bytes FROM p0 p LEFT JOIN gone g ON p.rel_path = g.rel_path)"""


def _onto(spark, sf_dir):
    linked = F.col("rel_path").like("%1.dat")
    return dst_manifest(spark, sf_dir).withColumn("ino", F.col("ino") - F.when(linked, 1_000_000_000).otherwise(0))


@query("link_plan_onto", f"WITH {_onto_sql(True)} SELECT * FROM plan")
def link_plan_onto(spark, sf_dir):
    return plans.link_plan(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), _onto(spark, sf_dir), overwrite=True, skip_specials=True)


@query("link_plan_blocked", f"WITH {_onto_sql(False)} SELECT * FROM plan")
def link_plan_blocked(spark, sf_dir):
    """Without overwriting: what is there already fails, and directories that fail hide what is below them."""
    return plans.link_plan(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), _onto(spark, sf_dir), skip_specials=True)


@query(
    "link_onto_summary",
    f"""WITH {_onto_sql(True)} SELECT count(*) FILTER (action IN ('hardlink', 'relink')) AS hard_links_created, count(*) FILTER (action = 'link_unchanged') AS hard_links_unchanged,
  count(*) FILTER (kind = 'file' AND (action = 'copy_from_update' OR action = 'replace' AND origin = 'update')) AS files_copied, coalesce(sum(size) FILTER (kind = 'file' AND (action = 'copy_from_update' OR action = 'replace' AND origin = 'update')), 0)::BIGINT AS bytes_copied,
  count(*) FILTER (kind = 'file' AND action = 'unchanged') AS files_unchanged, count(*) FILTER (kind = 'symlink' AND action IN ('symlink', 'replace')) AS symlinks_created, count(*) FILTER (kind = 'symlink' AND action = 'unchanged') AS symlinks_unchanged,
  count(*) FILTER (kind = 'dir' AND action IN ('mkdir', 'replace')) AS directories_created, count(*) FILTER (kind = 'dir' AND action = 'reuse_dir') AS directories_unchanged, count(*) FILTER (action = 'skip_special') AS specials_skipped, count(*) FILTER (action = 'error') AS errors,
  sum(removed_files)::BIGINT AS removed_files, sum(removed_dirs)::BIGINT AS removed_dirs, sum(removed_symlinks)::BIGINT AS removed_symlinks, sum(removed_bytes)::BIGINT AS removed_bytes FROM plan""",
)
def link_onto_summary(spark, sf_dir):
    return plans.link_summary(link_plan_onto(spark, sf_dir))


@query(
    "link_exclusive",
    f"""WITH {SRC_SQL}, {UPD_SQL}, j AS MATERIALIZED (SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, s.kind AS sk, d.kind AS uk,
  CASE WHEN d.kind IS NULL THEN 'none' WHEN s.kind = 'file' AND d.kind = 'file' AND s.size = d.size AND {_MT} THEN 'hardlink' ELSE CASE d.kind WHEN 'dir' THEN 'mkdir' WHEN 'file' THEN 'copy_from_update' WHEN 'symlink' THEN 'symlink' ELSE 'skip_special' END END AS action FROM src s FULL JOIN upd d ON s.rel_path = d.rel_path),
swapped AS (SELECT rel_path FROM j WHERE sk <> uk), below AS MATERIALIZED (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM j WHERE uk IS NULL) x JOIN swapped b ON x.a = b.rel_path)
SELECT j.rel_path, j.action FROM j ANTI JOIN below b ON j.rel_path = b.rel_path""",
)
def link_exclusive(spark, sf_dir):
    return plans.link_plan(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), update_exclusive=True, skip_specials=True).select("rel_path", "action")


@query(
    "link_delete",
    f"""WITH {SRC_SQL}, {UPD_SQL}, {DST_SQL}, kept AS (SELECT rel_path, max(CASE WHEN kind = 'dir' THEN 1 ELSE 0 END) AS d FROM (SELECT rel_path, kind FROM src UNION ALL SELECT rel_path, kind FROM upd) GROUP BY 1),
tops AS (SELECT d.* FROM dst d WHERE {PARENT.format(p='d.rel_path')} IN (SELECT k.rel_path FROM kept k JOIN dst e ON k.rel_path = e.rel_path WHERE k.d = 1 AND e.kind = 'dir') AND d.rel_path NOT IN (SELECT rel_path FROM kept))
SELECT DISTINCT rel_path, kind, size, 'remove' AS action FROM (SELECT * FROM tops UNION ALL SELECT d.* FROM dst d JOIN tops t ON t.kind = 'dir' AND starts_with(d.rel_path, t.rel_path || '/'))""",
)
def link_delete(spark, sf_dir):
    return plans.link_delete_plan(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), dst_manifest(spark, sf_dir)).drop("reason")


@query(
    "transfer_candidates",
    f"""WITH {BOTH}, big AS (SELECT {PARENT.format(p='rel_path')} AS f FROM dst GROUP BY 1 HAVING count(*) > 9)
SELECT s.rel_path, s.size, {PARENT.format(p='s.rel_path')} IN (SELECT f FROM big WHERE f IS NOT NULL) OR NOT coalesce(d.kind = 'file' AND s.size = d.size AND {_MT}, FALSE) AS send FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path WHERE s.kind = 'file'""",
)
def transfer_candidates(spark, sf_dir):
    return plans.transfer_candidates(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), max_entries=9)


@query(
    "transfer_newer",
    f"""WITH {BOTH} SELECT s.rel_path, s.size, NOT coalesce(d.kind = 'file' AND s.size = d.size AND {_MT}, FALSE) AND NOT coalesce({_NEWER}, FALSE) AS send FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path WHERE s.kind = 'file'""",
)
def transfer_newer(spark, sf_dir):
    return plans.transfer_candidates(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), keep_newer=True)


@query("failed_ancestors", f"WITH {SRC_SQL}, failed AS (SELECT rel_path FROM src WHERE kind = 'dir' AND regexp_matches(rel_path, '/c[0-9]7$')) SELECT rel_path, kind FROM src WHERE rel_path NOT IN (SELECT rel_path FROM failed) AND NOT list_has_any({UP.format(p='rel_path')}, (SELECT list(rel_path) FROM failed))")
def failed_ancestors(spark, sf_dir):
    m = src_manifest(spark, sf_dir)
    return plans.exclude_failed(m, m.where("kind = 'dir' and rel_path rlike '/c[0-9]7$'")).select("rel_path", "kind")


@query("hardlink_groups", f"WITH {SRC_SQL} SELECT dev, ino, count(*) AS n, min(rel_path) AS first FROM src WHERE kind = 'file' AND ino IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def hardlink_groups(spark, sf_dir):
    return plans.hardlink_groups(src_manifest(spark, sf_dir))


@query("already_linked", f"WITH {SRC_SQL}, {UPD_SQL} SELECT s.rel_path FROM src s JOIN upd d ON s.rel_path = d.rel_path AND s.kind = d.kind AND s.dev = d.dev AND s.ino = d.ino")
def already_linked(spark, sf_dir):
    return plans.already_linked(src_manifest(spark, sf_dir), update_manifest(spark, sf_dir))


@query(
    "copy_closure",
    f"""WITH {SRC_SQL}, {DST_SQL}, s AS (SELECT * FROM src WHERE kind <> 'other'), replaced AS (SELECT s.rel_path FROM s JOIN dst d ON s.rel_path = d.rel_path WHERE s.kind = 'dir' AND d.kind <> 'dir' OR s.kind <> 'dir' AND d.kind = 'dir'),
hidden AS (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM dst) x JOIN replaced r ON x.a = r.rel_path)
SELECT rel_path, kind, CASE WHEN kind = 'dir' THEN NULL ELSE size END AS size, link_target, origin FROM (
  SELECT s.rel_path, s.kind, s.size, s.link_target, 'src' AS origin FROM s UNION ALL SELECT d.rel_path, d.kind, d.size, d.link_target, 'dst' FROM dst d ANTI JOIN s ON d.rel_path = s.rel_path ANTI JOIN hidden h ON d.rel_path = h.rel_path)""",
)
def copy_closure(spark, sf_dir):
    """The destination after a preserving copy: every source entry, and what was only there and not replaced from above."""
    src, dst, keep = src_manifest(spark, sf_dir).where("kind <> 'other'"), dst_manifest(spark, sf_dir), parse_preserve("all")
    after = plans.apply_plan(src, dst, plans.copy_plan(src, dst, overwrite=True, preserve=keep), keep)
    of_src = src.select("rel_path", F.lit("src").alias("_o"))
    return after.join(of_src, "rel_path", "left").select("rel_path", "kind", F.when(F.col("kind") != "dir", F.col("size")).alias("size"), "link_target", F.coalesce("_o", F.lit("dst")).alias("origin"))


@query(
    "link_closure",
    f"""WITH {_onto_sql(True)}, made AS (SELECT * FROM plan WHERE action NOT IN ('skip_special', 'none', 'error', 'unchanged')), hidden AS (SELECT DISTINCT x.rel_path FROM (SELECT rel_path, unnest({UP.format(p='rel_path')}) AS a FROM onto) x JOIN made m ON x.a = m.rel_path AND m.action IN ('replace', 'relink'))
SELECT rel_path, kind, ino FROM (SELECT m.rel_path, m.kind, CASE WHEN m.action IN ('hardlink', 'relink', 'link_unchanged') THEN s.ino END AS ino FROM made m LEFT JOIN src s ON m.rel_path = s.rel_path
  UNION ALL SELECT d.rel_path, d.kind, d.ino FROM onto d ANTI JOIN made m ON d.rel_path = m.rel_path ANTI JOIN hidden h ON d.rel_path = h.rel_path)""",
)
def link_closure(spark, sf_dir):
    """The destination after a link run: links share the source's inode, copies have new ones (null here)."""
    src, upd, dst, keep = src_manifest(spark, sf_dir), update_manifest(spark, sf_dir), _onto(spark, sf_dir), parse_preserve("all")
    plan = link_plan_onto(spark, sf_dir)
    after = plans.apply_link_plan(src, upd, dst, plan, keep)
    shared = plan.select("rel_path", F.col("action").isin("hardlink", "relink", "link_unchanged").alias("_l"), F.col("action").isin("unchanged", "skip_special").alias("_k"))
    return after.join(shared, "rel_path", "left").select("rel_path", "kind", F.when(F.col("_l").isNull() | F.col("_l") | F.col("_k"), F.col("ino")).alias("ino"))


@query(
    "validate_manifest",
    f"""WITH {SRC_SQL}, m AS (SELECT rel_path, CASE WHEN mtime_ns % 1000 = 3 THEN 'pipe' ELSE kind END AS kind FROM src WHERE NOT (kind = 'dir' AND rel_path LIKE '%/c3') UNION ALL SELECT rel_path, kind FROM src WHERE mtime_ns % 500 = 7)
SELECT rel_path, 'duplicate path' AS problem FROM m GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT rel_path, CASE WHEN kind = 'pipe' THEN 'unknown kind' ELSE 'parent is missing' END FROM m WHERE kind = 'pipe' OR (rel_path <> '' AND {PARENT.format(p='rel_path')} NOT IN (SELECT rel_path FROM m))""",
)
def validate_manifest(spark, sf_dir):
    m = src_manifest(spark, sf_dir)
    bad = m.where("not (kind = 'dir' and rel_path like '%/c3')").withColumn("kind", F.when(F.col("mtime_ns") % 1000 == 3, "pipe").otherwise(F.col("kind")))
    return reports.validate_manifest(bad.unionByName(m.where("mtime_ns % 500 = 7")))


@query(
    "dry_run_report",
    f"""WITH {_COPY} SELECT rel_path, CASE WHEN action = 'skip_special' THEN 'skip ' || 'file "/s/' || rel_path || '" -> "/d/' || rel_path || '" (skip_special)' ELSE 'would copy ' || kind || ' "/s' || CASE WHEN rel_path = '' THEN '' ELSE '/' || rel_path END || '" -> "/d' || CASE WHEN rel_path = '' THEN '' ELSE '/' || rel_path END || '"' END AS line
FROM plan WHERE action NOT IN ('unchanged', 'reuse_dir')""",
)
def dry_run_report(spark, sf_dir):
    p = plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), overwrite=True, skip_specials=True)
    return reports.format_plan(p, "explain", "/s", "/d")


@query("throttle_estimate", f"WITH {_COPY}, t AS (SELECT count(*) FILTER (action <> 'unchanged' AND action <> 'skip_special') AS ops, coalesce(sum(1 + (greatest(1, size) - 1) // 1048576) FILTER (kind = 'file' AND action IN ('copy', 'replace')), 0)::BIGINT AS tokens FROM plan) SELECT ops, tokens, 0::BIGINT AS files_beyond, greatest(ops / 100.0, tokens / 250.0)::DOUBLE AS seconds FROM t")
def throttle_estimate(spark, sf_dir):
    return reports.throttle_estimate(copy_plan(spark, sf_dir), 100.0, 250.0, 1 << 20)


@query(
    "resolve_destinations",
    """WITH j AS (SELECT c_custkey // 3 AS job, '/s/' || c_custkey AS src, CASE c_custkey % 7 WHEN 0 THEN '/d/..' WHEN 1 THEN '/d/one' ELSE '/d/' END AS dst FROM customer),
r AS (SELECT *, CASE WHEN dst LIKE '%/' THEN '/d/' || regexp_extract(src, '[^/]*$') ELSE dst END AS resolved, count(*) OVER (PARTITION BY job) > 1 AS several FROM j)
SELECT job, src, dst, resolved, CASE WHEN dst = '/d/..' THEN 'destination ends in a dot step' WHEN several AND dst NOT LIKE '%/' THEN 'several sources need a slash at the end' WHEN count(*) OVER (PARTITION BY job, resolved) > 1 THEN 'two sources have this destination' END AS problem FROM r""",
)
def resolve_destinations(spark, sf_dir):
    k = F.col("c_custkey")
    dst = F.when(k % 7 == 0, "/d/..").when(k % 7 == 1, "/d/one").otherwise("/d/")
    return reports.resolve_destinations(table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("job"), F.concat(F.lit("/s/"), k.cast("string")).alias("src"), dst.alias("dst")))


@query(
    "resolve_onto_existing",
    """SELECT c_custkey AS job, '/s/' || c_custkey AS src, CASE WHEN c_custkey % 3 = 0 THEN '/d/' ELSE '/d/' || c_nationkey END AS dst, CASE WHEN c_custkey % 3 = 0 THEN '/d/' || c_custkey ELSE '/d/' || c_nationkey END AS resolved,
  CASE WHEN c_custkey % 3 <> 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'destination exists' END AS problem FROM customer""",
)
def resolve_onto_existing(spark, sf_dir):
    """Single sources onto destinations of which those of one region are there already."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    jobs = table(spark, sf_dir, "customer").select(k.alias("job"), F.concat(F.lit("/s/"), k.cast("string")).alias("src"), F.when(k % 3 == 0, "/d/").otherwise(F.concat(F.lit("/d/"), n)).alias("dst"))
    there = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("/d/"), F.col("n_nationkey").cast("string")).alias("path"))
    return reports.resolve_destinations(jobs, there)


def _acl(*entries: tuple[int, int, int]):
    """A list's blob: version 2, then tag, permissions and id of each entry."""
    return F.lit(bytearray(struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in entries)))


_NOBODY = 0xFFFFFFFF  # the id of entries that name no one
_RWX = "CASE WHEN {b} & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN {b} & 2 > 0 THEN 'w' ELSE '-' END || CASE WHEN {b} & 1 > 0 THEN 'x' ELSE '-' END"


@query(
    "acl_audit",
    f"""WITH {SRC_SQL}, f AS (SELECT rel_path, (mode >> 3) & 7 AS g, mode & 7 AS o, uid = 1002 AS own, {PARENT.format(p='rel_path')} LIKE '%/c5' AS heir FROM src WHERE kind = 'file'),
r AS (SELECT rel_path, own, unnest([{{'p': 'user:65534', 'b': CASE WHEN own THEN 0 ELSE o END, 'n': CASE WHEN heir THEN g ELSE o END}}, {{'p': 'group', 'b': CASE WHEN own THEN 0 ELSE g END, 'n': CASE WHEN heir THEN g & 5 ELSE g END}}, {{'p': 'other', 'b': CASE WHEN own THEN 5 ELSE o END, 'n': o}}]) AS r FROM f WHERE own OR heir)
SELECT rel_path, r.p AS principal, {_RWX.format(b='r.b')} AS before, {_RWX.format(b='r.n')} AS after, CASE WHEN own THEN 'source ACL is dropped' ELSE 'inherits a default ACL' END AS problem FROM r WHERE r.n & (7 - r.b) <> 0""",
)
def acl_audit(spark, sf_dir):
    """Files of one owner shut out a user; directories of one name let that user in by default."""
    m = src_manifest(spark, sf_dir)
    acl = lambda access, default: F.struct(F.lit(True).alias("captured"), access.alias("access"), default.alias("default"))
    shut = _acl((1, 7, _NOBODY), (2, 0, 65534), (4, 0, _NOBODY), (16, 5, _NOBODY), (32, 5, _NOBODY))
    open_ = _acl((1, 7, _NOBODY), (2, 7, 65534), (4, 5, _NOBODY), (16, 7, _NOBODY), (32, 5, _NOBODY))
    none = F.lit(None).cast("binary")
    src = m.withColumn("acl", acl(F.when((F.col("kind") == "file") & (F.col("uid") == 1002), shut), none))
    dst = m.withColumn("acl", acl(none, F.when((F.col("kind") == "dir") & F.col("rel_path").like("%/c5"), open_)))
    return plans.acl_audit(src, dst, parse_preserve("all"))


_LARGE = "action = 'replace' AND dst_kind = 'file' AND size > 20000000"


@query(
    "copy_plan_policy",
    f"""WITH {_COPY} SELECT rel_path, kind, size, CASE WHEN {_LARGE} THEN 'keep_large' ELSE action END AS action, dst_kind, CASE WHEN {_LARGE} THEN 0 ELSE removed_files END::BIGINT AS removed_files, removed_dirs, removed_symlinks, CASE WHEN {_LARGE} THEN 0 ELSE removed_bytes END::BIGINT AS removed_bytes, CASE WHEN {_LARGE} THEN 'large files stay' END AS reason FROM plan""",
)
def copy_plan_policy(spark, sf_dir):
    """The copy plan with a rule of the user's: a large file that is there is not replaced."""
    rule = Rule("large files stay", "dst_kind = 'file' and size > 20000000", "keep_large", of=("replace",))
    return plans.copy_plan(src_manifest(spark, sf_dir), dst_manifest(spark, sf_dir), overwrite=True, skip_specials=True, policy=(rule,))


@query(
    "error_digest",
    """WITH e AS (SELECT 'r' || (user_id % 4) AS run, event_id AS seq, 'cause ' || (user_id % 30) AS root_cause FROM events WHERE event_type = 'error'),
c AS (SELECT run, root_cause, min(seq) AS first, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first) AS k FROM c)
SELECT run, array_to_string(list(root_cause ORDER BY first) FILTER (k <= 5), ';') AS causes, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (k > 5), 0)::BIGINT AS suppressed FROM k GROUP BY run""",
)
def error_digest(spark, sf_dir):
    return reports.error_digest(errors(spark, sf_dir), 5).withColumn("causes", F.array_join("causes", ";"))


@query(
    "error_messages",
    """WITH e AS (SELECT 'r' || (user_id % 4) AS run, event_id AS seq, 'cause ' || (user_id % 30) AS root_cause FROM events WHERE event_type = 'error'),
c AS (SELECT run, root_cause, min(seq) AS first, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first) AS k FROM c)
SELECT run, 'multiple errors occurred:' || string_agg(chr(10) || '- ' || root_cause, '' ORDER BY first) FILTER (k <= 3) || CASE WHEN sum(n) FILTER (k > 3) > 0 THEN chr(10) || '(' || sum(n) FILTER (k > 3) || ' additional errors suppressed)' ELSE '' END AS message FROM k GROUP BY run""",
)
def error_messages(spark, sf_dir):
    return reports.error_messages(reports.error_digest(errors(spark, sf_dir), 3))


@query(
    "run_summaries",
    f"""WITH {SAMPLES_SQL}, s AS (SELECT run AS run_id, count(*) FILTER (op = 'unlink') AS files_skipped FROM samples WHERE side = 'source' GROUP BY 1), d AS (SELECT run AS run_id, count(*) FILTER (op = 'open-create') AS files_copied FROM samples WHERE side = 'destination' GROUP BY 1)
SELECT s.run_id, files_copied, files_skipped FROM s JOIN d ON s.run_id[2:]::INT // 2 = d.run_id[2:]::INT // 2""",
)
def run_summaries(spark, sf_dir):
    """Runs have samples of one side; the destination's of runs 2k + 1 is met with the source's of runs 2k."""
    s = samples(spark, sf_dir)
    pair = F.floor(F.substring("run", 2, 9).cast("int") / 2)
    side = lambda of: s.where(F.col("side") == of).groupBy(pair.alias("pair")).agg(F.min("run").alias("run"), F.count_if(F.col("op") == "open-create").alias("files_copied"), F.count_if(F.col("op") == "unlink").alias("files_skipped"))
    source = side("source")
    merged = plans.merge_run_summaries(source.drop("run"), side("destination").drop("run"), key="pair")
    return merged.join(source.select("pair", F.col("run").alias("run_id")), "pair").select("run_id", "files_copied", "files_skipped")


@query(
    "directory_completion",
    f"""WITH {SRC_SQL}, dirs AS (SELECT rel_path, rel_path NOT LIKE '%/c9' AS announced, rel_path LIKE '%/c8' AS failed FROM src WHERE kind = 'dir'), expected AS (SELECT {PARENT.format(p='rel_path')} AS f, count(*) AS n, count(*) FILTER (mtime_ns % 100 <> 1) AS p FROM src WHERE rel_path <> '' GROUP BY 1),
t AS (SELECT d.rel_path, d.announced, coalesce(e.n, 0) AS n, coalesce(e.p, 0) AS p FROM dirs d LEFT JOIN expected e ON d.rel_path = e.f WHERE NOT failed),
open_ AS (SELECT DISTINCT unnest(list_append({UP.format(p='rel_path')}, rel_path)) AS d FROM t WHERE NOT (announced AND p >= n)) SELECT rel_path, p AS processed, rel_path NOT IN (SELECT d FROM open_) AS complete FROM t""",
)
def directory_completion(spark, sf_dir):
    m = src_manifest(spark, sf_dir).select("rel_path", "kind", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"))
    expected = m.where("rel_path <> ''").groupBy(parent("rel_path").alias("rel_path")).agg(F.count(F.lit(1)).alias("expected"))
    dirs = m.where("kind = 'dir'").join(expected, "rel_path", "left").select("rel_path", (~F.col("rel_path").like("%/c9")).alias("announced"), F.coalesce("expected", F.lit(0)).alias("expected"), F.col("rel_path").like("%/c8").alias("failed"))
    return reports.directory_completion(dirs, m.where("rel_path <> '' and mtime_ns % 100 <> 1"))


@query("document_subtrees", f"WITH m AS (SELECT source || '/' || lang || '/d' || (doc_id % 50) || '/' || doc_id || '.txt' AS rel_path, n_chars FROM documents) SELECT d AS rel_path, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM (SELECT unnest({UP.format(p='rel_path')}) AS d, n_chars FROM m) GROUP BY d")
def document_subtrees(spark, sf_dir):
    return directory_rollup(document_manifest(spark, sf_dir)).select("rel_path", "files", "bytes")
