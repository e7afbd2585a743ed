"""Costs that must not grow faster than the input: what is evaluated once, and what is called once per group."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.operators import content_cache, history, suppress
from auditlake.operators.file_scan import scan_files
from auditlake.operators.lines import continues
from auditlake.options import ScanOptions, Suppression
from auditlake.plans import scan as full
from auditlake.plans.samples import AWS_KEY
from auditlake.streaming import posture

SECRETS_ONLY = {"line_rules": (), "file_rules": (), "state_rules_on": False}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Held:
    value = None
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def bucket(*rows):
    return pd.DataFrame(rows, columns=["repo", "path", "seq", "present", "finding", "sev"])


def test_one_call_takes_in_all_files_of_a_bucket():
    state = Held()

    def changes(*parts):
        return sorted((tuple(r) for f in posture.replace_versions((0,), iter(parts), state) for r in f.itertuples(index=False)), key=str)

    assert changes(bucket(("a", "x", 2, True, 0, -1), ("a", "y", 1, True, 0, -1), ("a", "x", 1, True, 5, 4)),
                   bucket(("a", "x", 2, True, 7, 2), ("a", "x", 2, True, 7, 3), ("a", "y", 1, True, 7, 4), (None, "x", 1, True, 0, -1))) == [
        ("a", "x", 2, 1, 0, 0, 0, 1, 0), ("a", "y", 1, 1, 0, 0, 0, 0, 1), (None, "x", 1, 1, 0, 0, 0, 0, 0)]
    # a late version, a deletion and a delivery again
    assert changes(bucket(("a", "x", 1, True, 5, 4), ("a", "y", 3, False, 0, -1), (None, "x", 1, True, 0, -1))) == [("a", "y", 3, -1, 0, 0, 0, 0, -1)]
    assert changes(bucket(("a", "x", 2, True, 7, 3), ("a", "y", 2, True, 8, 3))) == []
    assert changes(bucket(("a", "z", 2**62, True, 0, -1), ("a", "z", 2**62 + 1, True, 1, 0))) == [("a", "z", 2**62 + 1, 1, 1, 0, 0, 0, 0)]


@pytest.mark.parametrize("allow", [(), ("hunter2",)])
def test_a_text_is_lower_cased_once_for_all_hints(files, allow):
    found = scan_files(files(("a.py", f"k = '{AWS_KEY}'\n"), ("b.py", "x = 1\n")), ScanOptions(allow_secrets=list(allow), inline_suppressions=False),
                       **SECRETS_ONLY)
    assert "Contains(lower(text" not in optimized(found) and "Contains(lower(lambda l" not in optimized(found)
    assert [(r.rule_id, r.path, r.line) for r in found.collect()] == [("SEC001", "a.py", 1)]


def test_patch_lines_are_lower_cased_once_for_all_hints(spark):
    patch = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -0,0 +1 @@\n+k = '{AWS_KEY}'\n"
    found = history.scan_history(spark.createDataFrame([("r", 0, "c" * 40, patch)], "repo string, commit_seq int, commit string, patch string"))
    assert "Contains(lower(" not in optimized(found)
    assert [r.evidence[:6] for r in found.collect()] == ["SEC001"]


def test_open_lines_by_their_plain_definition(spark):
    lines = ["", " ", "f(", "f(a", "f(a)", "f)(", "a,", "a, \t", "a,  ", "a(\x1c", "a,x", "()", "a ,b (c) ", "x, ", "é,", "(((", ")))", "a,\n"]
    opened = [(t, t.count("(") > t.count(")") or t.rstrip().endswith((",", "("))) for t in lines]
    made = spark.createDataFrame(opened, "t string, want boolean").select("t", "want", continues(F.col("t")).alias("is"))
    assert [r for r in made.collect() if r["is"] != r["want"]] == []
    assert "CASE WHEN Contains(t" in optimized(made.select("is"))       # no copies of lines without a parenthesis


def test_findings_of_unseen_texts_are_made_once(spark, files, monkeypatch):
    written = []
    monkeypatch.setattr(content_cache, "materialize", lambda df, name, write=content_cache.materialize: (written.append(name), write(df, name))[1])
    cache = content_cache.ContentCache(spark, tempfile.mkdtemp(prefix="run-"))
    text = ("a.py", f"k = '{AWS_KEY}'\n")
    found = cache.scan(files(text, text, ("b.py", "x = 1\n")), ScanOptions(), **SECRETS_ONLY)
    assert [(r.rule_id, r.path) for r in found.collect()] == [("SEC001", "a.py")] * 2
    assert "found" in written


def test_each_check_of_a_scan_is_written_by_a_plan_of_its_own(spark, files, monkeypatch):
    """A plan of all checks is planned anew after each stage of every check: the driver's memory."""
    plans, write = {}, full.materialize

    def noted(df, name):
        plans[name] = optimized(df)
        return write(df, name)

    monkeypatch.setattr(full, "materialize", noted)
    table = files(("a.py", "eval(a)"), (".env", "A=1"), ("k.pem", "x"), ("requirements.txt", "flask"), ("Dockerfile", "FROM x:1"), ("huge.bin", ""))
    table = table.withColumn("size_bytes", F.when(F.col("path") == "huge.bin", 60 * 1024 * 1024).otherwise(F.col("size_bytes")))
    remotes = spark.createDataFrame([("r", "origin", "https://bob:hunt" + "er2pw@example.com/a")], "repo string, name string, url string")
    patch = f'diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+k = "{AWS_KEY}"\n'
    patches = spark.createDataFrame([("r", 0, "c" * 40, patch)], "repo string, commit_seq int, commit string, patch string")
    audits = spark.createDataFrame([("r", "npm", "package-lock.json", '{"vulnerabilities": {"a": {"severity": "high"}}}'), ("s", "npm", "p", "broken")],
                                   "repo string, tool string, target string, payload string")
    result = full.scan(table, remotes=remotes, patches=patches, tool_reports=audits,
                       suppressions=spark.createDataFrame([("r", "SEC051", "", "", "")], "repo string, rule_id string, path string, reason string, expires string"))

    found = plans["findings"]
    assert not [step for step in ("Join", "Window", "Generate", "LogicalRDD") if step in found] and found.count("Aggregate") == 1
    assert found.count("Relation [") == sum(name.endswith("-findings") for name in plans) == 9
    assert sorted((r.repo, r.rule_id, r.path) for r in result.findings.collect()) == [
        ("r", "SEC020", "a.py"), ("r", "SEC050", ".env"), ("r", "SEC052", ".git/config"), ("r", "SEC053", ".gitignore"),
        ("r", "SEC054", "huge.bin"), ("r", "SEC055", "<git-history>"), ("r", "SEC060", "requirements.txt"), ("r", "SEC062", "package-lock.json"),
        ("r", "SEC074", ".dockerignore"), ("s", "DEPS-SKIP", "-"), *[("s", "GIT-SKIP", "-")] * 3]


def test_suppressions_of_all_kinds_meet_in_one_join(spark):
    found = spark.createDataFrame([("r", "A", "p/q.py"), ("r", "B", "p/t/x.py"), ("r", "B", "q/x.py"), ("r", "D", "x.py"), ("r", "A", None),
                                   ("s", None, "x.py"), ("s", "C", "p"), ("r", "C", "p"), ("s", "E", "a*b")], "repo string, rule_id string, path string")
    rules = [Suppression("A", ""), Suppression("B", "p/"), Suppression("*", "x.*"), Suppression("C", "p", repo="s"), Suppression("E", "a*b", repo="s")]
    covered = suppress.matched_targets(found, suppress.suppression_table(spark, rules))
    assert optimized(covered).count("Join ") == 3       # a repository's own rules, shared rules, and the triples of covered pairs
    assert sorted(tuple(r) for r in covered.collect()) == [("r", "A", "p/q.py"), ("r", "B", "p/t/x.py"), ("r", "D", "x.py"), ("s", "C", "p"), ("s", "E", "a*b")]
