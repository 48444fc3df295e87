"""Manifests that are compared again and again, kept bucketed and sorted by path: joins of two of them move no row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fileledger.schema import MANIFEST_SCHEMA, conform


def store_manifest(m: DataFrame, path: str, buckets: int) -> DataFrame:
    """Writes a manifest under path in so many buckets, and gives it back as read from there.  Two manifests join without an exchange if they have as many buckets."""
    table = f"stored_manifest_{uuid.uuid4().hex}"
    conform(m).repartition(buckets, "rel_path").write.bucketBy(buckets, "rel_path").sortBy("rel_path").option("path", path).saveAsTable(table)
    return m.sparkSession.table(table)


def stored_manifest(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A manifest that store_manifest has written, in this application or in an earlier one."""
    table = f"stored_manifest_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MANIFEST_SCHEMA)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (rel_path) SORTED BY (rel_path) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
