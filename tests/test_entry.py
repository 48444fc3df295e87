import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "fileledger.llm" or name.startswith("fileledger.llm."):
            raise ModuleNotFoundError(name)

import importlib.machinery, importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("fileledger.llm") or (%r and name == "corpus_pipeline") else real(name, package)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "compare_trees" in q and "compare_trees" in o
assert not [n for n in q if n.startswith("op") or n == "pipeline"], sorted(q)
assert set(o) <= set(q)
"""


def test_entry_without_the_llm_folder():
    """With that subpackage gone, with or without the pipeline's file, every other query is still there."""
    for pipeline_too in (False, True):
        done = subprocess.run([sys.executable, "-c", HIDDEN % pipeline_too], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_derived_manifests_outlive_an_emptied_folder(spark):
    import shutil

    from fileledger.jobs import fixtures

    sf = "/root/testdata/sf0.001"
    n = fixtures.update_manifest(spark, sf).count()
    path = fixtures._kept[spark.sparkContext.applicationId, sf, "update_manifest"]
    assert fixtures.update_manifest(spark, sf).count() == n
    assert fixtures._kept[spark.sparkContext.applicationId, sf, "update_manifest"] == path
    shutil.rmtree(path.removeprefix("file://"))
    assert fixtures.update_manifest(spark, sf).count() == n


def test_queries_are_listed_without_a_session():
    """The entry module and its lists need no SparkSession."""
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries()) and SparkSession.getActiveSession() is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
