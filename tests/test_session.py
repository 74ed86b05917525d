import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from quoteflow import session

REPO = Path(__file__).resolve().parents[1]


def test_workers_get_the_package(tmp_path):
    """An Arrow query started from an empty folder, by a process that knows the repository on the driver only."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['ts11_ts12_ema'](spark, '/root/testdata/sf0.001').count())\n"
    )
    done = subprocess.run([sys.executable, "-c", script, str(REPO)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    def fake(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_root(fake(master))
    assert session.checkpoint_root(fake("yarn", "s3a://bucket/shared")) == "s3a://bucket/shared"
    assert session.checkpoint_root(fake("local[4]")).startswith("/tmp/")
