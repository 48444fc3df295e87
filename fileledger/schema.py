"""The manifest: one row per entry of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACL = T.StructType([T.StructField("captured", T.BooleanType()), T.StructField("access", T.BinaryType()), T.StructField("default", T.BinaryType())])
MANIFEST_SCHEMA = T.StructType(
    [T.StructField("rel_path", T.StringType(), False), T.StructField("kind", T.StringType(), False)]
    + [T.StructField(n, t) for n, t in (("size", T.LongType()), ("mode", T.IntegerType()), ("uid", T.LongType()), ("gid", T.LongType()), ("mtime_s", T.LongType()), ("mtime_ns", T.IntegerType()), ("ctime_s", T.LongType()), ("ctime_ns", T.IntegerType()), ("btime_s", T.LongType()), ("btime_ns", T.IntegerType()), ("atime_s", T.LongType()), ("atime_ns", T.IntegerType()), ("link_target", T.StringType()), ("dev", T.LongType()), ("ino", T.LongType()), ("acl", ACL))]
)
KINDS = ("file", "dir", "symlink", "other")
PERMISSION_BITS = 0o7777


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the manifest's columns; those it lacks are null, its other columns are left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST_SCHEMA.fields))
