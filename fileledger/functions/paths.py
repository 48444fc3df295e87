"""Row-local path expressions.  Paths are relative to the tree's root, whose own path is ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def depth(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """'' for entries of the root; null for the root."""
    p = _col(path)
    return F.when(p == "", F.lit(None)).otherwise(F.regexp_replace(F.regexp_extract(p, "^(.*/)?[^/]*$", 1), "/$", ""))


def ancestors(path: Column | str) -> Column:
    """Strict ancestors from '' down; an empty array for the root."""
    p = _col(path)
    parts = F.split(p, "/")
    strict = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(p == "", F.array().cast("array<string>")).otherwise(strict)


def self_and_ancestors(path: Column | str) -> Column:
    p = _col(path)
    return F.concat(ancestors(p), F.array(p))


def join_path(root: Column | str, rel: Column | str) -> Column:
    """root itself for the root's path, never with a slash at the end."""
    r = F.regexp_replace(_col(root), "(?<=.)/+$", "")
    return F.when(_col(rel) == "", r).when(r == "/", F.concat(r, _col(rel))).otherwise(F.concat_ws("/", r, _col(rel)))


def escape_path(path: Column | str) -> Column:
    return F.replace(_col(path), F.lit("\\"), F.lit("\\\\"))


def unescape_path(path: Column | str) -> Column:
    return F.replace(_col(path), F.lit("\\\\"), F.lit("\\"))


@F.pandas_udf(T.StringType())
def escape_path_bytes(raw):
    """Paths as bytes: a backslash is doubled, a byte that is no part of valid UTF-8 is written \\xHH."""
    import pandas as pd

    def one(b):
        if b is None:
            return None
        text = bytes(b).replace(b"\\", b"\\\\").decode("utf-8", "surrogateescape")
        return "".join(f"\\x{ord(c) - 0xDC00:02x}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text)

    return pd.Series([one(b) for b in raw])


@F.pandas_udf(T.BinaryType())
def unescape_path_bytes(escaped):
    """The bytes that escape_path_bytes wrote: \\xHH is a byte, two backslashes are one; any other backslash stands for itself."""
    import re

    import pandas as pd

    def one(text):
        plain = lambda m: b"\\" if m[0] == b"\\\\" else bytes([int(m[1], 16)])
        return None if text is None else re.sub(rb"\\\\|\\x([0-9a-f]{2})", plain, text.encode())

    return pd.Series([one(t) for t in escaped])
