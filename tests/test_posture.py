import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.functions.severity import SEVERITIES, WEIGHTS
from auditlake.operators import score
from auditlake.streaming.posture import count_levels, file_changes, posture_history, replace_version, standing_posture, start_posture
from tests_support import table

VERSIONS = "repo string, path string, size_bytes long, text string, tracked boolean, seq long"


class Held:
    """One file's state."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def part(*rows):
    return pd.DataFrame(rows, columns=["seq", "present", "finding", "sev"]).astype({"seq": "Float64", "finding": "Int64", "sev": "Int64"})


def changes(state, *parts):
    return [tuple(row)[2:] for frame in replace_version(("r", "p"), iter(parts), state) for row in frame.itertuples(index=False)]


def test_versions_replace_each_other():
    state = Held()
    first = part((1, True, None, None), (1, True, 7, 4), (1, True, 7, 4), (1, True, 8, 0))
    assert changes(state, first) == [(1, 1, 1, 0, 0, 0, 1)]
    assert changes(state, first) == []                                                      # delivered again
    assert changes(state, part((0, True, 9, 3))) == []                                      # late
    assert changes(state, part((2, True, None, None)), part((3, True, None, None), (3, True, 5, 2))) == [(3, 0, -1, 0, 1, 0, -1)]
    assert changes(state, part((4, False, None, None))) == [(4, -1, 0, 0, -1, 0, 0)]        # gone
    assert changes(state, part((5, True, None, None))) == [(5, 1, 0, 0, 0, 0, 0)]           # back, without findings
    assert changes(state, part((None, True, 5, 2))) == [] and changes(state) == []


def test_one_key_counts_once_by_its_worst_severity():
    assert count_levels(np.array([5, 5, 6, 5]), np.array([1, 3, 0, 2])).tolist() == [1, 0, 0, 1, 0]
    assert count_levels(np.array([], np.int64), np.array([], np.int64)).tolist() == [0] * 5


def test_standing_posture_follows_the_files(spark):
    """Batches with new, changed, repeated, late and deleted files: after each one, the posture of the newest versions."""
    base = tempfile.mkdtemp(prefix="run-")
    rng = random.Random(8)
    texts = ["x = 1\n", "eval(a)\n", "eval(a)\nos.system(b)\n", "hashlib.md5(x)\neval(a)\n", "", None]
    newest, sent, seen = {}, [], set()
    for batch in range(3):
        rows = []
        for _ in range(14):
            repo, path, seq = rng.choice("ab"), f"f{rng.randint(0, 4)}.py", batch * 100 + rng.randint(0, 99)
            if (repo, path, seq) not in seen:
                seen.add((repo, path, seq))
                rows.append((repo, path, 9, rng.choice(texts), True, seq))
        rows += [rng.choice(sent) for _ in range(4)] if sent else [("only", "dist/none.py", 1, "eval(a)", True, 0)]
        sent += rows
        for row in rows:
            if row[5] >= newest.get(row[:2], (-1,))[0]:
                newest[row[:2]] = (row[5], row[3])
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(VERSIONS).parquet(f"{base}/in")
        start_posture(stream, f"{base}/out", f"{base}/state").awaitTermination()
        left = [(repo, path, 9, text, True) for (repo, path), (_, text) in newest.items() if text is not None]
        files = spark.createDataFrame(left, "repo string, path string, size_bytes long, text string, tracked boolean")
        from auditlake.operators.file_scan import scan_files
        from auditlake.operators.findings import dedupe
        from auditlake.sources.files import discover
        want = {r.repo: r for r in score.posture(dedupe(scan_files(discover(files)).where("not ignored")), files).collect()}
        found = {r.repo: r for r in standing_posture(spark, f"{base}/out").collect()}
        assert {k: r.score for k, r in found.items() if r.files} == {k: r.score for k, r in want.items()}
        assert all((found[k].grade, found[k].findings, *[found[k][s] for s in SEVERITIES]) == (want[k].grade, want[k].findings, *[want[k][s] for s in SEVERITIES]) for k in want)
        assert {r.repo: r.files for r in found.values()} == {k: sum(x[0] == k for x in left) for k in found}
        last = {r.repo: r.score for r in sorted(posture_history(spark, f"{base}/out").collect(), key=lambda r: r.batch)}
        assert last == {k: r.score for k, r in found.items()}


def test_a_rerun_without_new_files_changes_nothing(spark):
    base = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame([("r", "a.py", 1, "eval(a)", True, 1)], VERSIONS).write.parquet(f"{base}/in")
    for _ in range(2):
        start_posture(spark.readStream.schema(VERSIONS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    assert [(r.files, r.findings) for r in standing_posture(spark, f"{base}/out").collect()] == [(1, 1)]


def plain_rollup(rows, levels, depth):
    groups = {}
    for row in rows:
        groups.setdefault(tuple(row[c] for c in levels[:depth]), []).append(row["sev"])
    return {key: (max(0, 100 - sum(WEIGHTS[SEVERITIES[s]] for s in sevs)), len(sevs), sum(s == 4 for s in sevs)) for key, sevs in groups.items()}


def test_rollup_against_plain_groups(spark):
    rng = random.Random(4)
    made = table(spark, [("R", rng.randint(0, 4), rng.choice(["a/x", "b/y", "top"]), n, "m", "", f"r{rng.randint(0, 4)}") for n in range(60)])
    made = made.withColumn("team", F.when(F.col("repo") == "r0", None).otherwise(F.right("repo", F.lit(1)).cast("int") % 2)).withColumn(
        "directory", F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)))
    levels = ["team", "repo", "directory"]
    rows = [r.asDict() for r in made.collect()]
    out = score.posture_rollup(made, levels).collect()
    for depth in range(4):
        found = {tuple(r[c] for c in levels[:depth]): (r.score, r.findings, r.CRITICAL) for r in out if r.depth == depth}
        assert found == plain_rollup(rows, levels, depth)
        assert all(r[c] is None for r in out if r.depth == depth for c in levels[depth:])


def test_rollup_of_repositories_without_findings(spark):
    made = table(spark, [("R", 4, "a/x", 1, "m", "", "r1")]).withColumn("team", F.lit("t")).withColumn("directory", F.lit("a"))
    repos = spark.createDataFrame([("t", "r1"), ("t", "r2"), ("u", "r3")], "team string, repo string")
    rows = {(r.depth, r.team, r.repo, r.directory): (r.score, r.grade, r.findings) for r in score.posture_rollup(made, ["team", "repo", "directory"], repos).collect()}
    bad, clean = (75, "C", 1), (100, "A", 0)
    assert rows == {(0, None, None, None): bad, (1, "t", None, None): bad, (1, "u", None, None): clean, (2, "t", "r1", None): bad,
                    (2, "t", "r2", None): clean, (2, "u", "r3", None): clean, (3, "t", "r1", "a"): bad}
    with pytest.raises(ValueError):
        score.posture_rollup(made, ["team", "repo"], repos.select("repo"))
    assert score.posture_rollup(made.limit(0), ["team", "repo"]).count() == 0
