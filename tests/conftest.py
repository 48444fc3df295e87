import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def manifest(spark, rows):
    """rows: path -> (kind, size, mtime_s) or a dict of columns; the directories above are added."""
    from fileledger.schema import MANIFEST_SCHEMA

    full = {}
    for path, row in rows.items():
        row = row if isinstance(row, dict) else dict(zip(("kind", "size", "mtime_s"), row))
        full[path] = {"kind": "file", "size": 1, "mode": 0o100644, "uid": 1000, "gid": 1000, "mtime_s": 100, "mtime_ns": 0, "ctime_s": 0, "ctime_ns": 0, "dev": 1, "ino": len(full) + 1} | row
    for path in list(full):
        parts = path.split("/") if path else []
        for k in range(len(parts)):
            full.setdefault("/".join(parts[:k]), {"kind": "dir", "size": 4096, "mode": 0o40755, "uid": 1000, "gid": 1000, "mtime_s": 100, "mtime_ns": 0, "ctime_s": 0, "ctime_ns": 0})
    full.setdefault("", {"kind": "dir", "size": 4096, "mode": 0o40755, "mtime_s": 100, "mtime_ns": 0, "ctime_s": 0, "ctime_ns": 0})
    names = [f.name for f in MANIFEST_SCHEMA.fields]
    return spark.createDataFrame([tuple({"rel_path": p, **r}.get(n) for n in names) for p, r in full.items()], MANIFEST_SCHEMA)


FOO = {"0.txt": {}, "bar/1.txt": {}, "bar/2.txt": {}, "bar/3.txt": {}, "baz/4.txt": {}, "baz/5.txt": {"kind": "symlink", "link_target": "../bar/2.txt"}, "baz/6.txt": {"kind": "symlink", "link_target": "/foo/bar/3.txt"}}
