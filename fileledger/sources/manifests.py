"""Manifests from inventories, from listings of a store, and generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.functions.paths import ancestors
from fileledger.schema import conform


def relative_path(path: Column, root: str) -> Column:
    """path below root, without slashes at the ends; '' for root itself, null outside it."""
    base = root.rstrip("/")
    p = F.regexp_replace(path, "(?<=.)/+$", "")
    inside = p.startswith(base + "/")
    return F.when(p == F.lit(base or "/"), "").when(inside, F.substring(p, len(base) + 2, 1 << 30))


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet", root: str = "/", mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """An inventory as a manifest.  mapping: manifest column -> expression over the inventory's columns; rel_path from 'path' by default."""
    df = spark.read.format(fmt).options(**options).load(path)
    mapping = {"rel_path": "path"} | (mapping or {})
    picked = {name: F.expr(expression) for name, expression in mapping.items()}
    picked["rel_path"] = relative_path(picked["rel_path"], root)
    rest = {c: F.col(c) for c in df.columns if c not in picked}
    return conform(df.select(*(e.alias(n) for n, e in (rest | picked).items())).where("rel_path is not null"))


def scan_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Files of any store Spark can list, with the directories above them; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    rel = relative_path(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), root)
    micros = F.unix_micros("modificationTime")
    leaves = f.select(rel.alias("rel_path"), F.lit("file").alias("kind"), F.col("length").alias("size"), F.floor(micros / 1_000_000).alias("mtime_s"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_ns")).where("rel_path is not null")
    dirs = leaves.select(F.explode(ancestors("rel_path")).alias("rel_path")).distinct().withColumn("kind", F.lit("dir"))
    return conform(leaves).unionByName(conform(dirs))


def generate_tree(spark: SparkSession, dirwidth: list[int], numfiles: int, filesize: int, leaf_files: bool = False) -> DataFrame:
    """A generated tree: dirwidth[k] directories in each directory of level k, numfiles files in every directory (or in the deepest only).

    Rows come from one range and mixed-radix arithmetic, level by level.
    """
    out = spark.range(1).select(F.lit("").alias("rel_path"), F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"))

    def folder(i: Column, level: int) -> Column:
        parts, rest = [], i
        for k in range(level - 1, -1, -1):
            parts.insert(0, F.concat(F.lit("dir"), F.pmod(rest, F.lit(dirwidth[k])).cast("string")))
            rest = F.floor(rest / dirwidth[k])
        return F.concat_ws("/", *parts)

    total = 1
    for level in range(len(dirwidth) + 1):
        if level:
            total *= dirwidth[level - 1]
            out = out.unionByName(spark.range(total).select(folder(F.col("id"), level).alias("rel_path"), F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size")))
        if numfiles and (not leaf_files or level == len(dirwidth)):
            file = F.concat(F.lit("file"), F.pmod("id", F.lit(numfiles)).cast("string"))
            path = file if not level else F.concat_ws("/", folder(F.floor(F.col("id") / numfiles), level), file)
            out = out.unionByName(spark.range(total * numfiles).select(path.alias("rel_path"), F.lit("file").alias("kind"), F.lit(filesize).cast("bigint").alias("size")))
    return conform(out)


def generated_summary(m: DataFrame) -> DataFrame:
    """One row: files, directories (the root aside), bytes."""
    return m.agg(F.count_if(F.col("kind") == "file").alias("files_created"), F.count_if((F.col("kind") == "dir") & (F.col("rel_path") != "")).alias("directories_created"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_written"))
