"""Manifests and telemetry derived from the test tables by arithmetic that Spark and DuckDB share, and the same as SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.functions.paths import ancestors
from fileledger.schema import MANIFEST_SCHEMA, conform
from fileledger.sources.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of derived manifests by application, test folder and name.
_kept: dict[tuple[str, str, str], str] = {}


def kept(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """make, with its manifest written to the shared folder by the first query of a session that asks for it: queries read manifests as tables, as they would be given."""

    @functools.wraps(make)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key in _kept:
            try:
                return spark.read.schema(MANIFEST_SCHEMA).parquet(_kept[key])
            except AnalysisException:  # the shared folder has been emptied
                pass
        _kept[key] = new_path(spark, make.__name__)
        make(spark, sf_dir).write.parquet(_kept[key])
        return spark.read.schema(MANIFEST_SCHEMA).parquet(_kept[key])

    return read


def with_directories(leaves: DataFrame) -> DataFrame:
    """leaves and every directory above them."""
    dirs = leaves.select(F.explode(ancestors("rel_path")).alias("rel_path")).distinct()
    plain = {"kind": F.lit("dir"), "size": F.lit(4096), "mode": F.lit(16877), "uid": F.lit(0), "gid": F.lit(0), "mtime_s": 1_000_000_000 + F.length("rel_path"), "mtime_ns": F.lit(0), "ctime_s": F.lit(0), "ctime_ns": F.lit(0)}
    return conform(leaves).unionByName(conform(dirs.withColumns(plain)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 200
    kind = F.when(k % 97 == 0, "other").when(k % 19 == 0, "symlink").otherwise("file")
    perm = F.when(k % 3 == 1, 436).when(k % 3 == 2, 493).otherwise(420) + F.when(k % 53 == 0, 2048).otherwise(0)
    folder = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.lit("/s"), F.col("o_orderstatus"), F.lit("/c"), c.cast("string"))
    return o.select(
        k.alias("k"),
        c.alias("c"),
        folder.alias("folder"),
        F.concat(folder, F.lit("/o"), k.cast("string"), F.lit(".dat")).alias("rel_path"),
        kind.alias("kind"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
        (F.when(kind == "file", 32768).when(kind == "symlink", 40960).otherwise(4096) + perm).alias("mode"),
        (1000 + F.col("o_custkey") % 7).alias("uid"),
        (100 + F.col("o_custkey") % 5).alias("gid"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime_s"),
        F.when(k % 4 == 0, 0).otherwise((k * 7919) % 1_000_000_000).cast("int").alias("mtime_ns"),
        F.lit(0).alias("ctime_s"),
        F.lit(0).alias("ctime_ns"),
        F.when(k % 10 != 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - 86400).alias("btime_s"),
        F.when(k % 10 != 0, 0).alias("btime_ns"),
        F.when(kind == "symlink", F.concat(F.lit("../o"), (k + 1).cast("string"), F.lit(".dat"))).alias("link_target"),
        F.lit(1).alias("dev"),
        F.when((k % 50).isin(0, 1), k - k % 2).otherwise(k).alias("ino"),
    )


@kept
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(_orders(spark, sf_dir))


@kept
def dst_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    kept = o.where((k % 11 != 0) & ~c.isin(7, 77, 42)).withColumns(
        {
            "size": F.col("size") + F.when(k % 13 == 0, 1).otherwise(0),
            "mtime_s": F.col("mtime_s") + F.when(k % 17 == 0, 3600).otherwise(0),
            "mtime_ns": F.when(k % 29 == 0, 0).otherwise(F.col("mtime_ns")),
            "kind": F.when((k % 101 == 0) & (F.col("kind") == "file"), "symlink").otherwise(F.col("kind")),
            "ino": F.col("ino") + 1_000_000_000,
        }
    )
    blank = {n: F.lit(None) for n in ("link_target", "btime_s", "btime_ns")}
    swapped = o.where(c == 42).select(F.col("folder").alias("rel_path")).distinct().withColumns({"kind": F.lit("file"), "size": F.lit(1), "mode": F.lit(33188), "uid": F.lit(1000), "gid": F.lit(100), "mtime_s": F.lit(1_100_000_000), "mtime_ns": F.lit(0), "ctime_s": F.lit(0), "ctime_ns": F.lit(0), "dev": F.lit(1), "ino": F.lit(5), **blank})
    extra = o.where(k % 23 == 0).withColumns({"rel_path": F.concat(F.lit("extra/x"), k.cast("string"), F.lit(".log")), "kind": F.lit("file"), "mode": F.lit(33188), "ino": k + 2_000_000_000, **blank})
    new = o.where((k % 31 == 0) & ~c.isin(7, 77, 42)).withColumns({"rel_path": F.concat(F.col("folder"), F.lit("/o"), k.cast("string"), F.lit(".new")), "kind": F.lit("file"), "mode": F.lit(33188), "ino": k + 3_000_000_000, **blank})
    parts = [conform(x) for x in (kept, extra, new)]
    leaves = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return with_directories(leaves.unionByName(conform(swapped)))


@kept
def update_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    same = o.where(((k % 3 == 0) | (k % 15 == 1)) & (c != 13)).withColumn("size", F.col("size") + F.when(k % 15 == 1, 10).otherwise(0))
    flips = o.where(c == 13).select(F.col("folder").alias("rel_path")).distinct().withColumns({"kind": F.lit("file"), "size": F.lit(7), "mode": F.lit(33188), "uid": F.lit(1000), "gid": F.lit(100), "mtime_s": F.lit(1_200_000_000), "mtime_ns": F.lit(0), "ctime_s": F.lit(0), "ctime_ns": F.lit(0)})
    new = o.where(k % 37 == 0).withColumns({"rel_path": F.concat(F.lit("upd/u"), k.cast("string"), F.lit(".dat")), "kind": F.lit("file"), "mode": F.lit(33188)})
    return with_directories(conform(same).unionByName(conform(flips)).unionByName(conform(new)))


@kept
def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    leaves = d.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (i % 50).cast("string")), F.concat(i.cast("string"), F.lit(".txt"))).alias("rel_path"), F.lit("file").alias("kind"), F.col("n_chars").alias("size"), F.lit(33188).alias("mode"), F.lit(0).alias("mtime_s"))
    return with_directories(leaves)


OPS = {"view": "stat", "click": "open-create", "purchase": "chmod", "error": "unlink", "signup": "mkdir"}


def sample_columns() -> list[Column]:
    """run, ts, side, op, latency_us, bytes, outcome of events."""
    op: Column = F.lit("stat")
    for event, name in OPS.items():
        op = F.when(F.col("event_type") == event, name).otherwise(op)
    return [
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "source").otherwise("destination").alias("side"),
        op.alias("op"),
        F.greatest(F.lit(1), F.round(F.col("value") * 1000)).cast("bigint").alias("latency_us"),
        F.col("user_id").cast("bigint").alias("bytes"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
    ]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*sample_columns())


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, seq, path, root_cause)"""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("run"), F.col("event_id").cast("bigint").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("cause "), (F.col("user_id") % 30).cast("string")).alias("root_cause"))


# ---- the same as SQL

_DIR = "'dir' AS kind, 4096::BIGINT AS size, 16877 AS mode, 0::BIGINT AS uid, 0::BIGINT AS gid, (1000000000 + length(rel_path))::BIGINT AS mtime_s, 0::BIGINT AS mtime_ns, NULL::BIGINT AS btime_s, NULL::VARCHAR AS link_target, NULL::BIGINT AS dev, NULL::BIGINT AS ino"
_LEAF = "rel_path, kind, size, mode, uid, gid, mtime_s, mtime_ns, btime_s, link_target, dev, ino"
#: Strict ancestors of column p, '' first.
UP = "list_transform(range(0, len(string_split({p}, '/'))), lambda i: array_to_string(string_split({p}, '/')[1:i], '/'))"
PARENT = "CASE WHEN {p} = '' THEN NULL WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"


def _tree(leaves: str, name: str) -> str:
    return f"""{name}_dirs AS MATERIALIZED (SELECT DISTINCT unnest({UP.format(p='rel_path')}) AS rel_path FROM {leaves}),
{name} AS MATERIALIZED (SELECT {_LEAF} FROM {leaves} UNION ALL SELECT rel_path, {_DIR} FROM {name}_dirs)"""


ORDERS_SQL = """ord0 AS (
  SELECT o_orderkey AS k, o_custkey % 200 AS c, o_custkey, o_totalprice, epoch(o_orderdate)::BIGINT AS t,
    'p' || substr(o_orderpriority, 1, 1) || '/s' || o_orderstatus || '/c' || (o_custkey % 200) AS folder,
    CASE WHEN o_orderkey % 97 = 0 THEN 'other' WHEN o_orderkey % 19 = 0 THEN 'symlink' ELSE 'file' END AS kind FROM orders
), ord AS MATERIALIZED (
  SELECT k, c, folder, folder || '/o' || k || '.dat' AS rel_path, kind, round(o_totalprice * 100)::BIGINT AS size,
    CASE kind WHEN 'file' THEN 32768 WHEN 'symlink' THEN 40960 ELSE 4096 END + CASE k % 3 WHEN 1 THEN 436 WHEN 2 THEN 493 ELSE 420 END + CASE WHEN k % 53 = 0 THEN 2048 ELSE 0 END AS mode,
    (1000 + o_custkey % 7)::BIGINT AS uid, (100 + o_custkey % 5)::BIGINT AS gid, t AS mtime_s,
    CASE WHEN k % 4 = 0 THEN 0 ELSE (k * 7919) % 1000000000 END::BIGINT AS mtime_ns,
    CASE WHEN k % 10 <> 0 THEN t - 86400 END AS btime_s,
    CASE WHEN kind = 'symlink' THEN '../o' || (k + 1) || '.dat' END AS link_target, 1::BIGINT AS dev,
    CASE WHEN k % 50 IN (0, 1) THEN k - k % 2 ELSE k END::BIGINT AS ino FROM ord0
)"""
SRC_SQL = f"{ORDERS_SQL},\n{_tree('ord', 'src')}"
DST_SQL = f"""dst_leaves AS (
  SELECT rel_path, CASE WHEN k % 101 = 0 AND kind = 'file' THEN 'symlink' ELSE kind END AS kind, size + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS size, mode, uid, gid,
    mtime_s + CASE WHEN k % 17 = 0 THEN 3600 ELSE 0 END AS mtime_s, CASE WHEN k % 29 = 0 THEN 0 ELSE mtime_ns END AS mtime_ns, btime_s, link_target, dev, ino + 1000000000 AS ino
  FROM ord WHERE k % 11 <> 0 AND c NOT IN (7, 77, 42)
  UNION ALL SELECT 'extra/x' || k || '.log', 'file', size, 33188, uid, gid, mtime_s, mtime_ns, NULL, NULL, dev, k + 2000000000 FROM ord WHERE k % 23 = 0
  UNION ALL SELECT folder || '/o' || k || '.new', 'file', size, 33188, uid, gid, mtime_s, mtime_ns, NULL, NULL, dev, k + 3000000000 FROM ord WHERE k % 31 = 0 AND c NOT IN (7, 77, 42)
  UNION ALL SELECT DISTINCT folder, 'file', 1, 33188, 1000, 100, 1100000000, 0, NULL::BIGINT, NULL, 1, 5 FROM ord WHERE c = 42
), {_tree('dst_leaves', 'dst')}"""
UPD_SQL = f"""upd_leaves AS (
  SELECT rel_path, kind, size + CASE WHEN k % 15 = 1 THEN 10 ELSE 0 END AS size, mode, uid, gid, mtime_s, mtime_ns, btime_s, link_target, dev, ino FROM ord WHERE (k % 3 = 0 OR k % 15 = 1) AND c <> 13
  UNION ALL SELECT DISTINCT folder, 'file', 7, 33188, 1000, 100, 1200000000, 0, NULL::BIGINT, NULL, NULL::BIGINT, NULL::BIGINT FROM ord WHERE c = 13
  UNION ALL SELECT 'upd/u' || k || '.dat', 'file', size, 33188, uid, gid, mtime_s, mtime_ns, btime_s, link_target, dev, ino FROM ord WHERE k % 37 = 0
), {_tree('upd_leaves', 'upd')}"""
SAMPLES_SQL = """samples AS (
  SELECT 'r' || (user_id % 4) AS run, ts, CASE WHEN user_id % 2 = 0 THEN 'source' ELSE 'destination' END AS side,
    CASE event_type WHEN 'click' THEN 'open-create' WHEN 'purchase' THEN 'chmod' WHEN 'error' THEN 'unlink' WHEN 'signup' THEN 'mkdir' ELSE 'stat' END AS op,
    greatest(1, round(value * 1000))::BIGINT AS latency_us, user_id::BIGINT AS bytes, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome FROM events
)"""
