"""Plans of permission and owner changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.functions.filters import FilterSettings, apply_filter, directly_matches, time_filter
from fileledger.functions.metadata import apply_mode, parse_mode_dsl, parse_owner_dsl

SET_IDS = 0o6000


def _by_kind(values: dict, make) -> Column:
    out = F.lit(None)
    for kind, v in values.items():
        out = F.when(F.col("kind") == kind, make(v)).otherwise(out)
    return out


def octal(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")


def chmod_plan(m: DataFrame, mode: str | None = None, owner: str | None = None, group: str | None = None, no_setid: bool = False, filter: FilterSettings | None = None, modified_before=None, created_before=None, now_s: int = 0, defer_dir_changes: bool = False, names: dict | None = None) -> DataFrame:
    """(rel_path, kind, action, pre_chmod, chown_uid, chown_gid, chmod, change, reason, seq).

    Ids that do not change are no part of a chown.  Symbolic links are never
    chmodded.  A chown drops set-id bits, so a chmod follows where the wanted mode
    has some; with no_setid the wanted mode has none, and they are cleared before
    the chown.  seq orders the steps: parents first, or last where directory changes
    are deferred.
    """
    settings = filter or FilterSettings()
    path, is_dir = F.col("rel_path"), F.col("kind") == "dir"
    aged = modified_before is not None or created_before is not None
    r = apply_filter(m, settings).withColumns({"_age": time_filter(modified_before, created_before, now_s) if aged else F.lit("matched"), "_match": directly_matches(settings, path, is_dir), "_old": F.col("mode").bitwiseAND(0o7777)})
    specs = parse_mode_dsl(mode) if mode else {}
    target = F.coalesce(_by_kind(specs, lambda s: apply_mode(F.col("mode"), s, is_dir)), F.col("_old")) if specs else F.col("_old")
    uid = _by_kind(parse_owner_dsl(owner, names), lambda v: F.lit(v).cast("bigint")) if owner else F.lit(None).cast("bigint")
    gid = _by_kind(parse_owner_dsl(group, names), lambda v: F.lit(v).cast("bigint")) if group else F.lit(None).cast("bigint")
    link = F.col("kind") == "symlink"
    r = r.withColumns({"_uid": F.when(uid != F.col("uid"), uid), "_gid": F.when(gid != F.col("gid"), gid)})
    chown = F.col("_uid").isNotNull() | F.col("_gid").isNotNull()
    wanted = target.bitwiseAND(0o7777 & ~SET_IDS) if no_setid else target
    has_ids = lambda c: c.bitwiseAND(SET_IDS) != 0
    restore = chown & (has_ids(wanted) | (has_ids(F.col("_old")) if no_setid else F.lit(False)))
    r = r.withColumns({"_wanted": F.when(link, F.col("_old")).otherwise(wanted)})
    chmod = F.when(~link & ((F.col("_wanted") != F.col("_old")) | restore), F.col("_wanted"))
    pre = F.when(~link & F.lit(no_setid) & chown & has_ids(F.col("_old")), F.col("_old").bitwiseAND(0o7777 & ~SET_IDS))
    r = r.withColumns({"_chmod": chmod, "_pre": pre})
    does = chown | F.col("_chmod").isNotNull()
    live = F.col("walk") == "included"
    action = F.when(F.col("walk") == "pruned", "pruned").when(F.col("walk") == "skipped", "skip_filter").when(is_dir & ~F.col("_match"), "traverse").when(F.col("_age") != "matched", "skip_time").when(does, "change").otherwise("unchanged")
    part = lambda label, old, new: F.when(new.isNotNull(), F.concat(F.lit(label + " "), old, F.lit("->"), new))
    change = F.concat_ws(", ", part("mode", octal(F.col("_old")), octal(F.when(F.col("_wanted") != F.col("_old"), F.col("_wanted")))), part("owner", F.col("uid").cast("string"), F.col("_uid").cast("string")), part("group", F.col("gid").cast("string"), F.col("_gid").cast("string")))
    r = r.withColumn("action", action)
    on = F.col("action") == "change"
    depth = F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))
    seq = F.when(is_dir & F.lit(defer_dir_changes), 1_000_000 - depth).otherwise(depth)
    why = F.when(F.col("action") == "skip_filter", F.col("reason")).when(F.col("action") == "skip_time", F.col("_age"))
    return r.select("rel_path", "kind", "action", F.when(on, F.col("_pre")).alias("pre_chmod"), F.when(on, F.col("_uid")).alias("chown_uid"), F.when(on, F.col("_gid")).alias("chown_gid"), F.when(on, F.col("_chmod")).alias("chmod"), F.when(on, change).alias("change"), why.alias("reason"), F.when(on & live, seq).alias("seq"))


def apply_permissions(m: DataFrame, plan: DataFrame) -> DataFrame:
    """The manifest after a chmod plan: new owners, and modes where one is set; without, a chown alone clears set-id bits of what is no directory."""
    acts = plan.where("action = 'change'").select("rel_path", "chown_uid", "chown_gid", "chmod")
    chown = F.col("chown_uid").isNotNull() | F.col("chown_gid").isNotNull()
    cleared = F.when(chown & F.col("kind").isin("file", "other"), F.col("mode").bitwiseAND(~SET_IDS)).otherwise(F.col("mode"))
    mode = F.when(F.col("chmod").isNotNull(), F.col("mode").bitwiseAND(~0o7777).bitwiseOR(F.col("chmod"))).otherwise(cleared)
    return m.join(acts, "rel_path", "left").withColumns({"mode": mode.cast("int"), "uid": F.coalesce("chown_uid", "uid"), "gid": F.coalesce("chown_gid", "gid")}).select(*m.columns)


def chmod_summary(plan: DataFrame) -> DataFrame:
    """One row: changed, unchanged and skipped counts by kind (other counts as file)."""
    kind = F.when(F.col("kind") == "other", "file").otherwise(F.col("kind"))
    names = {"file": "files", "dir": "directories", "symlink": "symlinks"}
    groups = {"changed": ("change",), "unchanged": ("unchanged",), "skipped": ("skip_filter", "skip_time")}
    return plan.agg(*(F.count_if(F.col("action").isin(*actions) & (kind == k)).alias(f"{n}_{g}") for g, actions in groups.items() for k, n in names.items()))
