"""Workers that have no copy of the package run every operator: what is sent to them can be unpickled without it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
assert spark.range(1).mapInPandas(lambda frames: (f.assign(id=int(_found())) for f in frames), "id long").first()[0] == 0
import __spark_entry__ as contract
for name, query in contract.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
        print("ran", name)
"""
FOUND = """
def _found():
    import importlib.util
    return importlib.util.find_spec("auditlake") is not None
"""


def test_every_operator_runs_on_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(FOUND + SCRIPT.format(repo=REPO))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    if "spark.range" in done.stderr and "assert" in done.stderr and "ran " not in done.stdout:
        pytest.skip("workers find the package here")
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("ran op") >= 13 and "ran pipeline" in done.stdout
