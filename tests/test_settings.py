import json

import pytest
from pyspark.sql import functions as F

from auditlake.operators.file_scan import scan_files
from auditlake.operators.history import scan_history
from auditlake.operators.repo_checks import missing_dockerignore
from auditlake.operators.settings import RepoSettings, rejected_patterns
from auditlake.options import ScanOptions
from auditlake.plans.samples import AWS_KEY
from auditlake.plans.scan import scan
from auditlake.sources.files import discover, discovery_stats

RULE = {"id": "OWN001", "title": "Word", "severity": "low", "pattern": "needle"}
SETTINGS = {
    "a": {"exclude": ["gen/", "*.tmp.py"], "custom_rules": [RULE], "fail_on": "low", "suppressions": [{"rule_id": "SEC001", "path": "ok/*"}]},
    "b": {"allow_secrets": ["AKIA"], "max_file_bytes": 200, "fail_on": "never", "history": False,
          "custom_rules": [RULE | {"severity": "critical", "pattern": "[Nn]eed", "extensions": ["js"]}, RULE | {"pattern": "(never", "id": "BAD1"}]},
    "c": {"inline_suppressions": False, "exclude": ["gen/"], "ignore_marker": "keep"},
    "d": {"ignore_marker": "keep", "history_commits": 1},
}
KEY = f'k = "{AWS_KEY}"\n'
TEXTS = {"src/x.py": KEY + "a needle\n", "src/y.js": "Need needle\n", "gen/z.py": KEY, "u.tmp.py": KEY, "ok/k.py": KEY, "big.py": KEY + "#" * 300,
         "m.py": f'k = "{AWS_KEY}"  # audit-ignore\n', "n.py": f'k = "{AWS_KEY}"  # keep\n', "Dockerfile": "FROM a:1\n", "gen/Dockerfile": "FROM b:1\n"}


def table(spark, rows):
    return spark.createDataFrame(rows, "repo string, settings string")


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(r, p, len(t), t, True) for r in "abcde" for p, t in TEXTS.items()]
    return spark.createDataFrame(rows, "repo string, path string, size_bytes long, text string, tracked boolean")


@pytest.fixture(scope="module")
def settings(spark):
    return RepoSettings(table(spark, [(r, json.dumps(s)) for r, s in SETTINGS.items()]))


def found(spark, tree, options, repo=None):
    files = discover(tree if repo is None else tree.where(F.col("repo") == repo), options)
    rows = scan_files(files, options, line_rules=(), file_rules=(), state_rules_on=False).collect()
    return sorted((r.repo, r.rule_id, r.severity, r.path, r.line, r.message, r.evidence, r.scanner, r.ignored) for r in rows)


def test_each_repository_is_scanned_as_if_alone(spark, tree, settings):
    """One pass with all settings gives what a scan of each repository with its own options gives."""
    want = []
    for repo in "abcde":
        own = json.loads(json.dumps(SETTINGS.get(repo, {})))
        own["custom_rules"] = [r for r in own.get("custom_rules", []) if r["id"] != "BAD1"]
        want += found(spark, tree, ScanOptions.from_mapping(own), repo)
    got = found(spark, tree, settings)
    assert got == sorted(want)
    custom = {(r[0], r[2], r[3]) for r in got if r[7] == "custom"}
    assert custom == {("a", "LOW", "src/x.py"), ("a", "LOW", "src/y.js"), ("b", "CRITICAL", "src/y.js")}
    few = RepoSettings(table(spark, [(r, json.dumps(s)) for r, s in SETTINGS.items()]), literals=0)
    assert few.shared_rules == few.excludes == [] and found(spark, tree, few) == got
    assert len(settings.shared_rules) == 2 and len(settings.excludes) == 3


def test_sizes_excludes_and_dockerfiles_by_repository(tree, settings):
    stats = {r.repo: (r.files_scanned, r.files_skipped) for r in discovery_stats(tree, settings).collect()}
    assert stats == {"a": (7, 3), "b": (9, 1), "c": (8, 2), "d": (10, 0), "e": (10, 0)}
    rows = missing_dockerignore(tree.where("path <> 'Dockerfile'"), settings=settings).collect()
    assert {r.repo for r in rows} == {"b", "d", "e"}


def test_history_by_repository(spark, settings):
    patch = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -0,0 +1 @@\n+{KEY}"
    rows = [(r, n, f"{n}" * 12, patch.replace(AWS_KEY, f"{AWS_KEY[:-1]}{n}")) for r in "abde" for n in (1, 2)]
    patches = spark.createDataFrame(rows, "repo string, commit_seq int, commit string, patch string")
    counts = {r.repo: r["count"] for r in scan_history(patches, settings=settings).groupBy("repo").count().collect()}
    assert counts == {"a": 2, "e": 2}       # b is off, d keeps commits before number 1
    limited = RepoSettings(table(spark, [("a", json.dumps({"history_bytes": len(patch)}))]))
    counts = {r.repo: r["count"] for r in scan_history(patches, settings=limited).groupBy("repo").count().collect()}
    assert counts == {"a": 1, "b": 2, "d": 2, "e": 2}


def test_whole_scan_with_settings(tree, settings):
    result = scan(tree, settings)
    gates = {r.repo: r.failed for r in result.gate().collect()}
    assert gates == {"a": True, "b": False, "c": True, "d": True, "e": True}
    rows = [(r.repo, r.rule_id, r.path) for r in result.findings.collect()]
    assert ("a", "SEC001", "ok/k.py") not in rows and ("e", "SEC001", "ok/k.py") in rows and ("a", "SEC001", "src/x.py") in rows
    assert ("b", "OWN001", "src/y.js") in rows and not any(r == "b" and rule == "SEC001" for r, rule, _ in rows)
    notes = [(n.repo, n.note) for n in result.notes.collect()]
    assert notes == [("b", "custom rule BAD1 left out: it has a pattern the engine rejects")]
    assert {r.repo: r.suppressed for r in result.stats.collect()}["a"] == 2


def test_settings_that_cannot_be_read_leave_a_note(spark, tree):
    rows = [("a", "{not json"), ("b", "[1]"), ("c", None), ("d", '{"colour": 1}'), ("d", '{"zeal": 1}'), (None, "{}"), ("e", '{"max_file_bytes": "x"}')]
    settings = RepoSettings(table(spark, rows))
    assert sorted((r.repo, r.note) for r in settings.notes.collect()) == [
        ("a", "settings are not valid JSON; defaults hold"), ("b", "settings are not a table; defaults hold"),
        ("d", "setting 'colour' is not known"), ("d", "several settings: the least text counts"),
        ("e", "setting 'max_file_bytes' is not a whole number; it keeps its default")]
    plain = ScanOptions()
    assert found(spark, tree, settings) == found(spark, tree, plain)
    assert found(spark, tree, RepoSettings(table(spark, rows).limit(0))) == found(spark, tree, plain)


def test_the_file_table_is_not_shuffled(tree, settings):
    files = scan_files(discover(tree, settings), settings, line_rules=(), file_rules=(), state_rules_on=False)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_many_settings_and_patterns(spark, tree):
    """Thousands of different settings stay columns; bad patterns are found among many."""
    rows = [(f"r{i}", json.dumps({"exclude": [f"x{i}/"], "custom_rules": [RULE | {"pattern": f"needle|no{i}no"}]})) for i in range(3000)]
    settings = RepoSettings(table(spark, [*rows, ("a", rows[7][1])]))
    assert len(settings.excludes) == len(settings.shared_rules) == 64
    assert {(r[0], r[3]) for r in found(spark, tree, settings) if r[7] == "custom"} == {("a", "src/x.py"), ("a", "src/y.js")}
    patterns = spark.createDataFrame([(p,) for p in [f"a{i}" for i in range(700)] + ["(", "[z", "*"]], "pattern string")
    assert sorted(rejected_patterns(patterns)) == ["(", "*", "[z"]
