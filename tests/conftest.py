import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("auditlake-tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build a files table from (path, text) pairs of one repository."""
    def build(*pairs, repo="r"):
        rows = [(repo, path, len(text.encode()), text, True) for path, text in pairs]
        return spark.createDataFrame(rows, "repo string, path string, size_bytes long, text string, tracked boolean")
    return build


@pytest.fixture
def hits(files):
    """(rule, line) pairs the per-file rules report for (path, text) pairs, by path."""
    from auditlake.operators.file_scan import scan_files

    def scan(*pairs, options=None):
        rows = scan_files(files(*pairs), options).where("not ignored").collect()
        out = {path: set() for path, _ in pairs}
        for row in rows:
            out[row.path].add((row.rule_id, row.line))
        return out
    return scan
