import datetime
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as contract
from auditlake import CustomRule, ScanOptions, Suppression, scan
from auditlake.operators import catalog, suppress
from auditlake.sources.files import discover, discovery_stats, read_tree
from auditlake.streaming.incremental import read_file_stream, start_scan


def ids(result):
    """Findings without the notes on checks that could not run."""
    return sorted((r.rule_id, r.path, r.line) for r in result.findings.collect() if not r.rule_id.endswith("-SKIP"))


def test_full_scan(spark, files):
    table = files(
        ("app.py", "eval(a)\neval(b)  # audit-ignore\n"), ("node_modules/x.py", "eval(a)"), ("Dockerfile", "FROM alpine"),
        ("requirements.txt", "flask"), ("big.py", "eval(a)"), ("img.png", "eval(a)"), ("k.pem", "x"), (".gitignore", ".env*"),
    ).withColumn("size_bytes", F.when(F.col("path") == "big.py", 2_000_001).otherwise(F.col("size_bytes")))
    result = scan(table, ScanOptions(notes=["hello"], max_file_bytes=2_000_000))
    assert ids(result) == [("SEC020", "app.py", 1), ("SEC051", "k.pem", 0), ("SEC060", "requirements.txt", 1),
                           ("SEC070", "Dockerfile", 1), ("SEC074", ".dockerignore", 0)]
    stats = result.stats.first()
    assert (stats.files_scanned, stats.files_skipped, stats.suppressed) == (4, 2, 1)
    assert result.posture().first().grade == "C" and result.gate().first().failed
    assert [r.note for r in result.notes.collect()] == ["hello"]


def test_suppressions_and_baseline_in_a_scan(spark, files):
    table = files(("a.py", "eval(a)\nos.system(b)"), ("b.py", "eval(a)"))
    options = ScanOptions(suppressions=[Suppression("SEC020", "a.py"), Suppression("SEC023", "", expires="2000-01-01")])
    result = scan(table, options, today=F.lit(datetime.date(2026, 1, 1)))
    assert ids(result) == [("SEC020", "b.py", 1), ("SEC023", "a.py", 2)]
    assert result.stats.first().suppressed == 1
    known = suppress.baseline_of(result.findings.where("path = 'b.py'"))
    moved = files(("a.py", "os.system(b)"), ("b.py", "\n\neval(a)\neval(z)"))
    again = scan(moved, options, baseline=known)
    assert ids(again) == [("SEC020", "b.py", 4), ("SEC023", "a.py", 1)]
    assert [r.note for r in again.notes.collect() if r.repo] == ["baseline: 1 known finding(s) ignored"]


def test_partial_scan_reads_listed_files_only(spark, files):
    table = files(("a.py", "eval(a)"), ("b.py", "eval(a)"), ("Dockerfile", "FROM x:1"), ("requirements.txt", "flask"), ("note.xyz", "token = 'abcdEFGH1234'"))
    listed = spark.createDataFrame([("r", "a.py"), ("r", "gone.py"), ("r", "../b.py"), ("r", "note.xyz")], "repo string, path string")
    result = scan(table, changed_files=listed)
    assert ids(result) == [("SEC015", "note.xyz", 1), ("SEC020", "a.py", 1), ("SEC060", "requirements.txt", 1)]
    assert (result.stats.first().files_scanned, result.stats.first().files_skipped) == (2, 2)


def test_history_and_audits_in_a_scan(spark, files):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+k = \"AKIA" + "Z" * 16 + "\"\n"
    patches = spark.createDataFrame([("r", 0, "c" * 40, patch)], "repo string, commit_seq int, commit string, patch string")
    reports = spark.createDataFrame([("r", "npm", "package-lock.json", '{"vulnerabilities": {"a": {"severity": "high"}}}')],
                                    "repo string, tool string, target string, payload string")
    found = lambda options: [r[0] for r in ids(scan(files(("a.txt", "")), options, patches=patches, tool_reports=reports))]
    assert found(None) == ["SEC055", "SEC062"]
    assert found(ScanOptions(history=False, deps_cves=False)) == []


def test_read_tree(spark):
    root = Path(tempfile.mkdtemp(prefix="run-"))
    for name, content in {"one/a.py": b"\xef\xbb\xbfeval(x)\xff", "one/sub/b.txt": b"x", "two/c.js": b"eval(" + b" " * 50 + b")"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    rows = {(r.repo, r.path): r for r in read_tree(spark, str(root)).collect()}
    assert set(rows) == {("one", "a.py"), ("one", "sub/b.txt"), ("two", "c.js")}
    assert rows["one", "a.py"].text == "eval(x)�" and rows["two", "c.js"].size_bytes == len(rows["two", "c.js"].text) == 56
    single = read_tree(spark, str(root / "one"), repo="me")
    assert {(r.repo, r.path) for r in single.collect()} == {("me", "a.py"), ("me", "sub/b.txt")}
    assert ids(scan(single)) == [("SEC020", "a.py", 1)]


WORKFLOW = "on: issues\njobs:\n  a:\n    steps:\n      - run: echo ${{ github.event.issue.title }}\n"


def test_hidden_files_of_a_tree(spark):
    root = Path(tempfile.mkdtemp(prefix="run-"))
    key = "AKIA" + "Q" * 16
    names = {".env": f"AWS={key}\n", ".gitignore": "*.log\n", ".github/workflows/ci.yml": WORKFLOW, "pkg/__init__.py": "eval(x)", "_conf.yml": "a: 1",
             "pkg/a.py": "", "my file.py": "eval(y)", "a/b/c/.d/_e.py": "eval(z)"}
    for name, text in names.items():
        (root / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "r" / name).write_text(text)
    tree = read_tree(spark, str(root))
    assert {r.path: r.text for r in tree.collect()} == names
    assert {r.tracked for r in tree.collect()} == {None}
    found = ids(scan(tree))
    assert {("SEC041", ".github/workflows/ci.yml", 5), ("SEC020", "pkg/__init__.py", 1), ("SEC020", "a/b/c/.d/_e.py", 1)} <= set(found)
    assert any(path == ".env" for _, path, _ in found) and not any(rule in ("SEC050", "SEC053") for rule, _, _ in found)
    listed = spark.createDataFrame([("r", ".env"), ("r", "pkg/a.py")], "repo string, path string")
    known = read_tree(spark, str(root), tracked=listed)
    assert {r.path for r in known.where("tracked").collect()} == {".env", "pkg/a.py"}
    assert {"SEC050", "SEC053"} <= {rule for rule, _, _ in ids(scan(known))}
    assert read_tree(spark, tempfile.mkdtemp(prefix="run-")).count() == 0


def test_missing_inputs_leave_notes(spark, files):
    notes = lambda result: sorted((r.repo, r.rule_id, r.message[:12]) for r in result.findings.where("rule_id like '%-SKIP'").collect())
    assert notes(scan(files(("a.txt", "")))) == [("r", "DEPS-SKIP", "No CVE data:"), ("r", "GIT-SKIP", "The history "), ("r", "GIT-SKIP", "The remotes ")]
    unknown = files(("a.txt", "")).withColumn("tracked", F.lit(None).cast("boolean"))
    assert len(notes(scan(unknown, ScanOptions(history=False, deps_cves=False)))) == 2
    broken = files(("package.json", "{\"dependencies\": "))
    assert ("r", "DEPS-SKIP", "package.json") in notes(scan(broken, ScanOptions(deps_cves=False)))


def test_a_repository_with_history_alone_fails_its_gate(spark, files):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+k = \"AKIA" + "Z" * 16 + "\"\n"
    patches = spark.createDataFrame([("bare", 600, "c" * 40, patch)], "repo string, commit_seq int, commit string, patch string")
    result = scan(files(("a.txt", "")), patches=patches)
    assert {r.repo: r.failed for r in result.gate().collect()} == {"r": False, "bare": True}
    assert {r.repo: r.CRITICAL for r in result.posture().collect()} == {"r": 0, "bare": 1}
    assert {r.repo: r.files_scanned for r in result.stats.collect()} == {"r": 1, "bare": 0}


def test_nothing_is_cut_by_default(spark, files):
    key = "AKIA" + "R" * 16
    long = "x = 1; " * 2_000 + "eval(a)"
    table = files(("far.py", long), ("big.py", "# pad\n" * 400_000 + "eval(b)\nk = '" + key + "'\n"), ("open.py", "f(" + "1,\n" * 6_000 + "eval(c))"))
    found = ids(scan(table))
    assert {("SEC020", "far.py", 1), ("SEC020", "big.py", 400_001)} <= set(found)
    assert any(path == "big.py" and line == 400_002 for _, path, line in found) and any(path == "open.py" for _, path, _ in found)
    patches = spark.createDataFrame([("r", n, f"{n:040d}", "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n" + ("+" + "y" * 99 + "\n") * (90_000 if n == 0 else 1)
                                      + ("+k = '" + key + "'\n" if n == 501 else "")) for n in (0, 1, 501)],
                                    "repo string, commit_seq int, commit string, patch string")
    assert "SEC055" in {rule for rule, _, _ in ids(scan(files(("a.txt", "")), patches=patches))}


def test_discovery_runs_before_the_text_is_read(spark, files):
    out = tempfile.mkdtemp(prefix="run-") + "/files"
    files(("a.py", "x"), ("dist/b.py", "x")).write.parquet(out)
    stats = discovery_stats(spark.read.parquet(out))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "Exchange" not in discover(spark.read.parquet(out))._jdf.queryExecution().executedPlan().toString()


def test_the_file_pass_has_no_shuffle(spark, files):
    from auditlake.operators.file_scan import scan_files
    plan = scan_files(files(("a.py", "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("ArrowEvalPython") == 1


def test_catalog(spark):
    rules = catalog.list_rules(spark).collect()
    assert len(rules) == 91 and [r.rule_id for r in rules] == sorted(r.rule_id for r in rules)
    custom = [CustomRule("CORP1", "Mine", "LOW", "x+")]
    assert len(catalog.list_rules(spark, custom).collect()) == 92
    row = catalog.explain_rule(spark, "sec089").first()
    assert (row.rule_id, row.cwe, row.kind) == ("SEC089", "CWE-120", "code") and ".c" in row.applies
    assert " && " in catalog.explain_rule(spark, "SEC038").first().pattern
    assert catalog.explain_rule(spark, "corp1", custom).first().kind == "custom"
    for entry in catalog._entries():
        assert catalog.explain_rule(spark, entry[0].lower()).columns[0] == "rule_id"
    try:
        catalog.explain_rule(spark, "SEC999")
        raise AssertionError("an unknown rule must raise")
    except ValueError:
        pass


def test_stream_scan(spark, files):
    base = tempfile.mkdtemp(prefix="run-")
    files(("a.py", "eval(a)")).write.parquet(f"{base}/in")
    run = lambda: start_scan(read_file_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/state",
                             suppressions=suppress.suppression_table(spark, [Suppression("SEC023")])).awaitTermination()
    run()
    files(("b.py", "eval(a)\nos.system(c)"), ("dist/c.py", "eval(a)")).write.mode("append").parquet(f"{base}/in")
    run()
    rows = spark.read.parquet(f"{base}/out").collect()
    assert sorted((r.rule_id, r.path, r.batch) for r in rows) == [("SEC020", "a.py", 0), ("SEC020", "b.py", 1)]


def test_contract(spark):
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names) and len(names) > 60
    assert contract.entry(spark).count() > 0
