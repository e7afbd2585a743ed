import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake.options import DEFAULT_EXCLUDES, ScanOptions
from auditlake.plans.scan import scan
from auditlake.functions.globs import exclude_pattern
from auditlake.sources import tree
from auditlake.sources.files import discovery_stats, read_tree
from auditlake.sources.tree import by_bytes, excludes_all_below, list_tree


def grow(names: dict) -> Path:
    root = Path(tempfile.mkdtemp(prefix="run-"))
    for name, content in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return root


def test_only_what_a_scan_reads_is_opened(spark):
    """The oversized file has 200 GB without a byte on disk: a run that opened it would not end."""
    names = {"r/a.py": "eval(x)", "r/node_modules/b.py": "eval(y)", "r/photo.png": "x", "r/.gitignore": "*.log", "r/requirements.txt": "a\n",
             "r/deep/er/.env": "A=1", "r/deep/build/c.py": "eval(z)", "s/Dockerfile": "FROM a:1"}
    root = grow(names)
    with open(root / "r" / "big.py", "wb") as file:
        file.truncate(200_000_000_000)
    options = ScanOptions(max_file_bytes=1000)
    rows = {f"{r.repo}/{r.path}": r for r in read_tree(spark, str(root), options=options).collect()}
    assert set(rows) == {*names, "r/big.py"} and rows["r/big.py"].size_bytes == 200_000_000_000
    assert {n for n, r in rows.items() if r.text is not None} == {"r/a.py", "r/.gitignore", "r/requirements.txt", "r/deep/er/.env", "s/Dockerfile"}
    files = read_tree(spark, str(root), options=options)
    stats = {r.repo: (r.files_scanned, r.files_skipped) for r in discovery_stats(files, options).collect()}
    assert stats == {"r": (3, 3), "s": (1, 0)}
    found = {(r.rule_id, r.path) for r in scan(files, options).findings.collect()}
    assert {("SEC020", "a.py"), ("SEC060", "requirements.txt"), ("SEC074", ".dockerignore")} <= found
    pruned = {f"{r.repo}/{r.path}" for r in read_tree(spark, str(root), options=options, prune=True).collect()}
    assert pruned == {*names, "r/big.py"} - {"r/node_modules/b.py", "r/deep/build/c.py"}


def test_excluded_directories_are_not_listed(spark):
    """A directory that cannot be listed stops a walk that enters it; the walk that prunes does not."""
    root = grow({"r/ok.py": "", "r/vendor/in/x.py": ""})
    loop = root / "r" / "again"
    os.symlink(root / "r", loop)
    assert [r.rel for r in list_tree(spark, str(root), DEFAULT_EXCLUDES, True).collect()] == ["r/ok.py"]
    assert sorted(r.rel for r in list_tree(spark, f"file://{root}").collect()) == ["r/ok.py", "r/vendor/in/x.py"]
    assert list_tree(spark, str(root / "missing")).count() == 0


@pytest.mark.parametrize("patterns", [DEFAULT_EXCLUDES, ["docs/*"], ["docs/*/*"], ["docs/**"], ["/docs/"], ["d?cs/"], ["*"], ["**"], ["docs"], ["a/b/"], []])
def test_a_directory_is_closed_only_if_all_below_is_excluded(patterns):
    import re
    closed, whole = excludes_all_below(patterns), exclude_pattern(patterns)
    matches = (lambda p: False) if whole is None else (lambda p: re.match(whole.replace(r"\z", r"\Z"), p) is not None)
    below = ["x", "x/y", "x/y/z", "x/y/z/w", "long name.txt", ".a/.b"]
    for directory in ["docs", "a", "a/b", "a/b/c", "node_modules", "x/node_modules", "x/docs", "pkg.egg-info", "y.map", "yarn.lock", "docs/sub"]:
        if closed(directory):
            assert all(matches(f"{directory}/{p}") for p in below), directory
        else:
            assert not all(matches(f"{directory}/{p}") for p in ["\x01" + "/\x01" * n for n in range(9)]), directory


def test_rounds_spread_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(tree, "FIRST_ENTRIES", 2)
    monkeypatch.setattr(tree, "ENTRIES", 5)
    names = {f"r/{'/'.join('abcdefgh'[:k % 9 + 1])}/f{k}.py": "x" * k for k in range(60)}
    rows = list_tree(spark, str(grow(names))).collect()
    assert {r.rel: r.size_bytes for r in rows} == {n: len(t) for n, t in names.items()} and len(rows) == 60


def test_tasks_follow_bytes(spark):
    """One directory with many files is many tasks of about equal bytes; a file larger than a task is one."""
    rows = [(f"one/f{i}", 1_000_000, True) for i in range(3000)] + [("one/huge", 900_000_000, True)] + [(f"one/skip{i}", 5_000_000, False) for i in range(2000)]
    listing = spark.createDataFrame(rows, "rel string, size_bytes long, wanted boolean")
    dealt = by_bytes(listing, task_bytes=50_000_000).withColumn("task", F.spark_partition_id())
    loads = [r.bytes or 0 for r in dealt.groupBy("task").agg(F.sum(F.when(F.col("wanted"), F.col("size_bytes"))).alias("bytes")).collect()]
    assert sum(loads) == 3_900_000_000 and max(loads) <= 900_000_000 + 50_000_000 and sorted(loads)[-2] <= 110_000_000 and len(loads) >= 40
    assert by_bytes(listing.limit(0)).count() == 0
