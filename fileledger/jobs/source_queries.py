"""Queries over what is read, generated and written: inventories, listings, generated trees, plan tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fileledger.functions.paths import escape_path, escape_path_bytes, unescape_path, unescape_path_bytes
from fileledger.functions.text import format_micros
from fileledger.jobs.entries import query
from fileledger.jobs.fixtures import SAMPLES_SQL, SRC_SQL, samples, src_manifest, table
from fileledger.jobs.plan_queries import _COPY, copy_plan
from fileledger.operators import reports
from fileledger.operators.rollup import directory_rollup
from fileledger.sources import manifests
from fileledger.sources.scratch import new_path


@query("read_inventory", f"WITH {SRC_SQL} SELECT rel_path, kind, size, mode, uid, gid, mtime_s, mtime_ns, link_target, dev, ino FROM src")
def read_inventory(spark, sf_dir):
    """A manifest from a JSON inventory with absolute paths and names of its own."""
    path = new_path(spark, "inventory")
    m = src_manifest(spark, sf_dir)
    absolute = F.concat(F.lit("/data/set/"), F.col("rel_path"))
    m.select(absolute.alias("path"), F.col("size").alias("bytes"), "kind", "mode", F.col("uid").alias("owner"), "gid", "mtime_s", "mtime_ns", "link_target", "dev", "ino").write.json(path)
    spark_schema = "path string, bytes bigint, kind string, mode int, owner bigint, gid bigint, mtime_s bigint, mtime_ns int, link_target string, dev bigint, ino bigint"
    found = manifests.read_manifest(spark, path, "json", "/data/set/", {"size": "bytes", "uid": "owner"}, schema=spark_schema)
    return found.select("rel_path", "kind", "size", "mode", "uid", "gid", "mtime_s", "mtime_ns", "link_target", "dev", "ino")


@query(
    "scan_listing",
    """WITH c AS (SELECT 'nation=' || c_nationkey AS d, length(c_name) + 1 AS n FROM customer)
SELECT d AS rel_path, sum(n)::BIGINT AS bytes, 0::BIGINT AS dirs FROM c GROUP BY d UNION ALL SELECT '', sum(n)::BIGINT, count(DISTINCT d)::BIGINT FROM c""",
)
def scan_listing(spark, sf_dir):
    """Bytes by directory of files that a listing of the shared folder finds."""
    path = new_path(spark, "listing")
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_nationkey").alias("nation"), "c_name").write.partitionBy("nation").text(path)
    root = re.sub("^[a-z0-9]+:/*(?=/)", "", path)
    found = directory_rollup(manifests.scan_files(spark, path, root))
    return found.select("rel_path", "bytes", (F.col("dirs") - 1).alias("dirs"))  # each directory counts itself


_TREE = """n AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS b, (SELECT count(*) FROM supplier) AS f, (SELECT count(*) FROM part) AS z),
one AS (SELECT 'dir' || unnest(range(a)) AS p FROM n), two AS (SELECT p || '/dir' || unnest(range(b)) AS p FROM one, n), d AS (SELECT '' AS p UNION ALL SELECT p FROM one UNION ALL SELECT p FROM two)"""


def _generated(spark, sf_dir):
    """A tree as wide as there are regions and nations, with a file for each supplier in every directory."""
    count = {n: table(spark, sf_dir, n).count() for n in ("region", "nation", "supplier", "part")}
    return manifests.generate_tree(spark, [count["region"], count["nation"]], count["supplier"], count["part"])


@query("generated_tree", f"WITH {_TREE} SELECT p AS rel_path, 'dir' AS kind, NULL::BIGINT AS size FROM d UNION ALL SELECT CASE WHEN p = '' THEN '' ELSE p || '/' END || 'file' || unnest(range(f)), 'file', z FROM d, n")
def generated_tree(spark, sf_dir):
    return _generated(spark, sf_dir).select("rel_path", "kind", "size")


@query("generated_summary", f"WITH {_TREE}, t AS (SELECT (SELECT count(*) FROM d) AS k, f, z FROM n) SELECT (k * f)::BIGINT AS files_created, (k - 1)::BIGINT AS directories_created, (k * f * z)::BIGINT AS bytes_written FROM t")
def generated_summary(spark, sf_dir):
    return manifests.generated_summary(_generated(spark, sf_dir))


@query("plan_sink", f"WITH {_COPY} SELECT rel_path, kind, size, action, dst_kind, removed_files, removed_dirs, removed_symlinks, removed_bytes, CASE WHEN rel_path = '' THEN 0 ELSE len(string_split(rel_path, '/')) END::INT AS step FROM plan")
def plan_sink(spark, sf_dir):
    """A copy plan as written for its executors, by action, and read back."""
    path = new_path(spark, "plan")
    reports.write_plan(copy_plan(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.withColumn("step", F.col("step").cast("int")).withColumn("action", F.col("action").cast("string"))


@query("escaped_paths", "WITH p AS (SELECT c_custkey, replace(c_name, '#', chr(92)) || chr(92) || c_mktsegment AS p FROM customer) SELECT c_custkey, replace(p, chr(92), chr(92) || chr(92)) AS escaped, p AS plain FROM p")
def escaped_paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    escaped = escape_path(F.concat(F.replace("c_name", F.lit("#"), F.lit("\\")), F.lit("\\"), F.col("c_mktsegment")))
    return c.select("c_custkey", escaped.alias("escaped"), unescape_path(escaped).alias("plain"))


@query(
    "escaped_bytes",
    """WITH p AS (SELECT c_custkey, replace(c_name, '#', chr(92)) AS a, 128 + c_custkey % 128 AS b, c_mktsegment || 'é' AS c FROM customer)
SELECT c_custkey, replace(a, chr(92), chr(92) || chr(92)) || chr(92) || 'x' || lower(lpad(hex(b), 2, '0')) || c AS escaped, hex(encode(a)) || lpad(hex(b), 2, '0') || hex(encode(c)) AS plain FROM p""",
)
def escaped_bytes(spark, sf_dir):
    """Paths that are no UTF-8 (one byte of 128 or more before an ASCII letter), escaped and made bytes again."""
    c = table(spark, sf_dir, "customer")
    byte = F.unhex(F.hex(F.lit(128) + F.col("c_custkey") % 128))
    raw = F.concat(F.encode(F.replace("c_name", F.lit("#"), F.lit("\\")), "UTF-8"), byte, F.encode(F.concat("c_mktsegment", F.lit("é")), "UTF-8"))
    escaped = c.select("c_custkey", escape_path_bytes(raw).alias("escaped"))
    return escaped.withColumn("plain", F.hex(unescape_path_bytes("escaped")))


@query(
    "latency_labels",
    f"""WITH {SAMPLES_SQL} SELECT latency_us, count(*) AS n, CASE WHEN latency_us < 1000 THEN latency_us || 'µs' WHEN latency_us < 1000000 THEN printf('%.1f', latency_us / 1e3) || 'ms' ELSE printf('%.1f', latency_us / 1e6) || 's' END AS label FROM samples GROUP BY 1""",
)
def latency_labels(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("latency_us").agg(F.count(F.lit(1)).alias("n")).withColumn("label", format_micros(F.col("latency_us")))
