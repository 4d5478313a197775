"""What a cluster needs: a shared folder and the package on the workers."""

import os
import subprocess
import sys
import tempfile
from types import SimpleNamespace

import pytest

from cohortloom import session


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
    context.getCheckpointDir = lambda: "hdfs://shared/"
    assert session.shared_folder(fake) == "hdfs://shared"


def test_workers_import_the_package_from_any_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', e.queries()['anova_oneway'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=280)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
