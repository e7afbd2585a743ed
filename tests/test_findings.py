import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.functions.identity import with_identity
from auditlake.operators import diff, findings, score, suppress
from auditlake.options import GATE_OFF, ScanOptions, Suppression
from auditlake.schemas import BASELINE, FINDING_COLUMNS
from auditlake.functions.severity import SEVERITIES
from tests_support import table

def plain(*severities):
    return [("R", s, f"p{i}", 1, "m", "") for i, s in enumerate(severities)]


@pytest.mark.parametrize("severities, want", [
    ([], (100, "A")), ([4], (75, "C")), ([3], (90, "A")), ([2] * 4, (88, "B")), ([3] * 4, (60, "D")), ([3] * 6, (40, "F")),
    ([0] * 50, (100, "A")), ([4] * 20 + [3] * 30, (0, "F")), ([1] * 10, (90, "A")), ([1] * 11, (89, "B")),
])
def test_score(spark, severities, want):
    repos = spark.createDataFrame([("r",)], "repo string")
    row = score.posture(table(spark, plain(*severities)), repos).first()
    assert (row.score, row.grade) == want
    assert sum(row[s] for s in SEVERITIES) == row.findings == len(severities)


def test_gate(spark):
    repos = spark.createDataFrame([("r",), ("empty",)], "repo string")
    gated = lambda fail_on, *sev: {r.repo: r.failed for r in score.gate(table(spark, plain(*sev)), fail_on, repos).collect()}
    assert gated("high", 2, 0) == {"r": False, "empty": False}
    assert gated("HIGH", 3) == {"r": True, "empty": False}
    assert gated("info", 0) == {"r": False, "empty": False}
    for off in GATE_OFF:
        assert gated(off, 4)["r"] is False
    with pytest.raises(ValueError):
        score.gate(table(spark, plain(1)), "severe")


def test_dedupe_keeps_the_most_severe_first_reported(spark):
    rows = [("A", 1, "p", 1, "m" * 80 + "x", "low"), ("A", 3, "p", 1, "m" * 80 + "y", "first"), ("A", 3, "p", 1, "m" * 80, "second"),
            ("A", 1, "p", 2, "m", "")]
    out = {r.line: r for r in findings.dedupe(table(spark, rows)).collect()}
    assert len(out) == 2 and out[1].evidence == "first" and out[1].sev == 3
    assert findings.dedupe(table(spark, rows)).columns == FINDING_COLUMNS


def test_fingerprints(spark):
    rows = [("A", 1, "p\\q", 1, "m", " e "), ("A", 1, "p\\q", 2, "m", "e"), ("A", 1, "p/q", 1, "m", "f"), ("B", 1, "p/q", 1, "m", "")]
    out = with_identity(table(spark, rows)).collect()
    assert len({r.fingerprint for r in out}) == 4 and all(len(r.fingerprint) == 12 for r in out)
    assert out[0].stable_fingerprint == out[1].stable_fingerprint != out[2].stable_fingerprint


def kept(spark, rows, sups, today=datetime.date(2026, 6, 1)):
    out = suppress.apply_suppressions(table(spark, rows), suppress.suppression_table(spark, sups), F.lit(today))
    return {(r.rule_id, r.path) for r in out.collect()}


@pytest.mark.parametrize("sup, covered", [
    (Suppression("A"), True), (Suppression("*", "src/api.py"), True), (Suppression("A", "api.py"), False), (Suppression("A", "src/"), True),
    (Suppression("A", "src"), True), (Suppression("A", "sr"), False), (Suppression("A", "s*y"), True), (Suppression("A", "src/a[!b]i.py"), True),
    (Suppression("A", "src\\api.py"), True), (Suppression("B", "src/api.py"), False), (Suppression("A", "", expires="2026-06-01"), True),
    (Suppression("A", "", expires="2026-05-31"), False), (Suppression("A", "", expires="2027-1-1"), False),
    (Suppression("A", "", expires="garbage"), False), (Suppression("A", "", expires="31-12-2027"), False),
    (Suppression("A", "", expires="2026-13-40"), False), (Suppression("A", "", repo="other"), False), (Suppression("A", "", repo="r"), True),
])
def test_suppression(spark, sup, covered):
    assert kept(spark, [("A", 3, "src/api.py", 1, "m", "")], [sup]) == (set() if covered else {("A", "src/api.py")})


def test_baseline(spark):
    rows = [("A", 3, "p", 5, "m", "ev"), ("B", 3, "p", 5, "m", "ev"), ("C", 3, "q", 1, "m" * 90, "")]
    now = table(spark, rows)
    entries = suppress.baseline_of(table(spark, [("A", 3, "p", 1, "old", "ev"), ("C", 3, "q", 1, "m" * 90, "")]))
    legacy = spark.createDataFrame([("r", "B", "p", 4, "m", "")], BASELINE)
    left = lambda known: {r.rule_id for r in suppress.subtract_baseline(now, known).collect()}
    assert left(entries) == {"B"}
    assert left(legacy) == {"A", "B", "C"}
    assert left(entries.where("false")) == {"A", "B", "C"}
    assert left(suppress.baseline_of(now)) == set()


def test_accept_finding(spark):
    now = table(spark, [("A", 3, "p", 5, "m", "ev"), ("B", 3, "p", 5, "m", "ev")])
    prints = {r.rule_id: r.fingerprint for r in with_identity(now).collect()}
    none = suppress.suppression_table(spark, [])
    row = suppress.accept_finding(now, none, prints["A"][:7].upper(), "known").first()
    assert (row.rule_id, row.path, row.reason, row.expires) == ("A", "p", "known", "")
    assert suppress.accept_finding(now, suppress.suppression_table(spark, [Suppression("A", "p")]), prints["A"]).count() == 0
    for bad in ("abc", "zzzzzzzz"):
        with pytest.raises(ValueError):
            suppress.accept_finding(now, none, bad)
    with pytest.raises(ValueError):
        suppress.accept_finding(now.union(now), none, prints["A"])
    wanted = spark.createDataFrame([("r", prints["A"][:8]), ("r", prints["B"]), ("other", prints["A"])], "repo string, prefix string")
    rows = suppress.accept_findings(now, suppress.suppression_table(spark, [Suppression("B", "")]), wanted).collect()
    assert sorted((r.repo, r.status, r.rule_id) for r in rows if r.status != "covered") == [("other", "unknown", None), ("r", "accepted", "A")]
    assert [r.prefix for r in rows if r.status == "covered"] == [prints["B"]]


def test_shared_suppressions_meet_pairs_not_repositories(spark):
    """Rules for all repositories join the distinct (rule, path) pairs: neither side grows with repositories x rules."""
    many = spark.range(20_000).select(F.concat(F.lit("r"), (F.col("id") % 2_000).cast("string")).alias("repo"),
                                      F.concat(F.lit("R"), (F.col("id") % 5).cast("string")).alias("rule_id"),
                                      F.concat(F.lit("d/f"), (F.col("id") % 10).cast("string")).alias("path"))
    rules = suppress.suppression_table(spark, [Suppression(f"X{i}", f"d/f{i}") for i in range(5_000)] + [
        Suppression("R1", "d/f1"), Suppression("*", "d/f[2]*"), Suppression("R3", "d/", repo="r3")])
    covered = suppress.matched_targets(many, rules)
    found = {(r.repo, r.rule_id, r.path) for r in covered.collect()}
    want = {(r.repo, r.rule_id, r.path) for r in many.collect()
            if (r.rule_id, r.path) == ("R1", "d/f1") or "f2" in r.path or (r.repo, r.rule_id) == ("r3", "R3")}
    assert found == want
    joins = [line for line in covered._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {line}"]
    assert joins and all("=" in line or "<=>" in line for line in joins) and not any("Cross" in line for line in joins)


def test_places_across_ranges(spark):
    """Places of findings dealt to many ranges, one repository and one line holding most of them, against a plain sort."""
    rng = random.Random(3)
    rows = [("r" if rng.random() < 0.8 else f"q{rng.randint(0, 3)}", f"R{rng.randint(0, 3)}", rng.randint(0, 4),
             "hot.py" if rng.random() < 0.5 else f"p{rng.randint(0, 30)}", 1 if rng.random() < 0.5 else rng.randint(0, 9), f"m{n}") for n in range(3_000)]
    made = spark.createDataFrame(rows, "repo string, rule_id string, sev int, path string, line int, message string").repartition(5).select(
        "*", *[F.lit("").alias(c) for c in ("title", "severity", "evidence", "fix", "cwe", "confidence", "scanner")], F.lit(0).alias("scan_seq"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.repo, r.message): r.place for r in findings.placed(made).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for repo in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: (-r[2], r[3], r[4], r[5]))
        want.update({(repo, r[5]): n for n, r in enumerate(own, 1)})
    assert found == want
    assert findings.placed(made.limit(0)).count() == 0


def test_suppressions_stay_in_their_repository(spark):
    rows = [(rule, 3, path, 1, "m", "") for rule in "AB" for path in ("p/q.py", "x.py", "p/r/s.py")]
    both = table(spark, rows).union(table(spark, rows).withColumn("repo", F.lit("s")))
    rules = [Suppression("A", "", repo="r"), Suppression("B", "p/*.py", repo="s"), Suppression("*", "x.py")]
    out = suppress.split_suppressed(both, suppress.suppression_table(spark, rules)).where("suppressed").collect()
    assert {(r.repo, r.rule_id, r.path) for r in out} == {("r", "A", "p/q.py"), ("r", "A", "x.py"), ("r", "A", "p/r/s.py"), ("s", "B", "p/q.py"), ("s", "B", "p/r/s.py"),
                                                         ("r", "B", "x.py"), ("s", "A", "x.py"), ("s", "B", "x.py")}
    plan = suppress.matched_targets(both, suppress.suppression_table(spark, rules))._jdf.queryExecution().optimizedPlan().toString()
    assert "repo" in plan and "Join Inner, (rule_key" not in plan


def test_baseline_of_a_repository_that_became_clean(spark):
    import tempfile

    from auditlake.sinks.tables import write_baseline
    out = tempfile.mkdtemp(prefix="run-") + "/baseline"
    now = table(spark, [("A", 3, "p", 5, "m", "ev")])
    scanned = now.select("repo").distinct()
    write_baseline(now, out, scanned)
    assert [r.rule_id for r in spark.read.parquet(out).collect()] == ["A"]
    write_baseline(now.where("false"), out, scanned)
    known = spark.read.parquet(out)
    assert [r.rule_id for r in known.collect()] == [""] and suppress.subtract_baseline(now, known).count() == 1


def test_long_messages_are_not_one_finding(spark):
    rows = table(spark, [("A", 3, "p", 5, "m" * 80 + "1", ""), ("A", 3, "p", 5, "m" * 80 + "2", "")])
    assert findings.dedupe(rows).count() == 2 and sorted(r.place for r in findings.placed(rows).collect()) == [1, 2]


def paired(old, new):
    """Pair greedily, list by list: what the closed form must equal."""
    added, removed, same = [], [], 0
    for group in {f[0] for f in old + new}:
        before, after = [f for f in old if f[0] == group], [f for f in new if f[0] == group]
        stacks = defaultdict(list)
        for f in before:
            stacks[f[1]].append(f)
        loose = []
        for f in after:
            if stacks[f[1]]:
                stacks[f[1]].pop()
                same += 1
            else:
                loose.append(f)
        rest = [f for key in dict.fromkeys(f[1] for f in before) for f in stacks[key]]
        n = min(len(loose), len(rest))
        same += n
        added += loose[n:]
        removed += rest[n:]
    return sorted(f[2] for f in added), sorted(f[2] for f in removed), same


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_diff_against_pairing(spark, block):
    rng = random.Random(block)
    schema = "repo string, stable_id string, rule_id string, path string, line int, message string, sev int, pos long"
    sides, want = {True: [], False: []}, {}
    for case in range(60):
        olds, news = [], []
        for side, rows in ((False, olds), (True, news)):
            for pos in range(rng.randint(0, 9)):
                group, line = rng.choice("ab"), rng.randint(1, 3)
                rows.append((group, line, pos))
                sides[side].append((f"c{case}", group, "R", "p", line, "m", 1, pos))
        want[f"c{case}"] = paired(olds, news)
    out = diff.diff_reports(*[spark.createDataFrame(sides[s], schema) for s in (False, True)], block=block)
    rows, counts = out.rows.collect(), {r.repo: r for r in out.counts.collect()}
    for case, (added, removed, same) in want.items():
        of = lambda status: sorted(r.pos for r in rows if r.repo == case and r.status == status)
        assert (of("added"), of("removed")) == (added, removed), case
        if case in counts:
            c = counts[case]
            assert (c.added, c.removed, c.unchanged) == (len(added), len(removed), same)


def test_options_from_mapping(spark):
    opts = ScanOptions.from_mapping({
        "exclude": ["x/"], "allow_secrets": "abc", "history": "False", "history_commits": True, "fail_on": "severe", "bogus": 1,
        "deps_cves": "maybe", "max_file_bytes": 10, "suppressions": [{"rule_id": "A"}, 5],
        "custom_rules": [{"id": "C1", "pattern": "a", "severity": "bad", "extensions": ["PY", ".js"]}, {"id": "C2", "pattern": "("},
                         {"pattern": "x"}, {"id": "C3"}, 7, {"id": "C4", "pattern": "(?P<n>ab)(?P=n)"}], "baseline": "known.json"})
    assert opts.excludes[-1] == "x/" and len(opts.excludes) == 23
    assert (opts.allow_secrets, opts.history, opts.history_commits, opts.fail_on, opts.max_file_bytes) == ([], False, None, "high", 10)
    assert [r.id for r in opts.custom_rules] == ["C1", "C4"] and opts.baseline == "known.json"
    assert opts.custom_rules[0].severity == "MEDIUM" and opts.custom_rules[0].extensions == (".py", ".js")
    assert opts.suppressions == [Suppression("A")]
    assert len(opts.notes) == 10
