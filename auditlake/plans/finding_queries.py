"""Queries over finding tables: algebra, suppression, diff, reports and documents."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from auditlake.functions.identity import stable_fingerprint, with_identity
from auditlake.functions.severity import parse_severity, severity_level
from auditlake.operators import catalog, diff, findings, score, suppress
from auditlake.operators.secrets import SECRET_RULES
from auditlake.options import Suppression
from auditlake.plans import corpus
from auditlake.plans import oracle_sql as sql
from auditlake.plans import file_queries, repo_queries  # noqa: F401  their SQL is part of the full scan's
from auditlake.plans.registry import ORACLES, query
from auditlake.sinks import documents
from auditlake.sources import reports

TODAY = datetime.date(2026, 1, 1)
DEDUPED = f"""{sql.EVENT_FINDINGS},
dd AS (SELECT repo, rule_id, path, line, message, sev, severity, min(evidence) AS evidence, any_value(title) AS title,
  any_value(fix) AS fix, any_value(cwe) AS cwe, any_value(confidence) AS confidence
  FROM ev GROUP BY repo, rule_id, path, line, message, sev, severity)"""


def _events(spark, sf_dir):
    return corpus.event_findings(spark, sf_dir)


def _deduped(spark, sf_dir):
    return findings.dedupe(_events(spark, sf_dir))


# ---------------------------------------------------------------- algebra

@query("deduplicated_findings", f"WITH {DEDUPED} SELECT repo, rule_id, path, line, sev, message, evidence FROM dd")
def deduplicated_findings(spark, sf_dir):
    return _deduped(spark, sf_dir).select("repo", "rule_id", "path", "line", "sev", "message", "evidence")


@query("scanner_union", f"""WITH {sql.EVENT_FINDINGS} SELECT scanner, rule_id, count(*) AS findings FROM (
  SELECT 'events' AS scanner, rule_id FROM ev UNION ALL
  SELECT 'labels', CASE WHEN toxic = 1 THEN 'LBTOXIC' ELSE 'LBCLEAN' END FROM labels) GROUP BY ALL""")
def scanner_union(spark, sf_dir):
    labels = corpus.table(spark, sf_dir, "labels").withColumn("repo", F.lit("labels")).select(*findings.as_finding(
        F.when(F.col("toxic") == 1, "LBTOXIC").otherwise("LBCLEAN"), "Label", "LOW", "A label.",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")), 0, "", "", "low", "labels", 1, fix=""))
    return findings.union_findings([_events(spark, sf_dir), labels]).groupBy("scanner", "rule_id").agg(
        F.count(F.lit(1)).alias("findings"))


@query("ordered_findings", f"""WITH {DEDUPED} SELECT repo, rule_id, path, line,
  row_number() OVER (PARTITION BY repo ORDER BY sev DESC, path, line, message, evidence) AS place FROM dd""")
def ordered_findings(spark, sf_dir):
    return findings.placed(_deduped(spark, sf_dir)).select("repo", "rule_id", "path", "line", "place")


@query("gating_findings", f"WITH {DEDUPED} SELECT repo, count(*) AS gating FROM dd WHERE sev > 0 GROUP BY repo")
def gating_findings(spark, sf_dir):
    return findings.gating(_deduped(spark, sf_dir)).groupBy("repo").agg(F.count(F.lit(1)).alias("gating"))


@query("report_rows", f"""WITH {DEDUPED} SELECT repo, {sql.fingerprint()} AS id, {sql.stable()} AS stable_id, rule_id, title, severity, message,
  path, line, evidence, fix, cwe, confidence, 'events' AS scanner FROM dd""")
def report_rows(spark, sf_dir):
    return findings.to_report_rows(_deduped(spark, sf_dir))


_GROUPS = """s AS (SELECT repo, {by} sum(CASE sev WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS d, max(sev) AS worst, count(*) AS findings,
  count(*) FILTER (WHERE sev = 4) AS c4, count(*) FILTER (WHERE sev = 3) AS c3, count(*) FILTER (WHERE sev = 2) AS c2,
  count(*) FILTER (WHERE sev = 1) AS c1, count(*) FILTER (WHERE sev = 0) AS c0 FROM dd GROUP BY {group})"""
_GRADE = """CAST(greatest(0, 100 - coalesce(d, 0)) AS INT) AS score, CASE WHEN 100 - coalesce(d, 0) >= 80 AND worst = 4 THEN 'D'
  WHEN 100 - coalesce(d, 0) >= 90 THEN 'A' WHEN 100 - coalesce(d, 0) >= 80 THEN 'B' WHEN 100 - coalesce(d, 0) >= 70 THEN 'C'
  WHEN 100 - coalesce(d, 0) >= 50 THEN 'D' ELSE 'F' END AS grade, coalesce(findings, 0) AS findings,
  coalesce(c4, 0) AS "CRITICAL", coalesce(c3, 0) AS "HIGH", coalesce(c2, 0) AS "MEDIUM", coalesce(c1, 0) AS "LOW", coalesce(c0, 0) AS "INFO" """


@query("score_and_grade", f"""WITH {DEDUPED}, {_GROUPS.format(by='', group='repo')},
r AS (SELECT DISTINCT 'u' || (user_id % 20) AS repo FROM events)
SELECT r.repo, {_GRADE} FROM r LEFT JOIN s ON r.repo = s.repo""")
def score_and_grade(spark, sf_dir):
    repos = corpus.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo"))
    return score.posture(_deduped(spark, sf_dir), repos)


@query("score_by_file", f"WITH {DEDUPED}, {_GROUPS.format(by='path,', group='repo, path')} SELECT repo, path, {_GRADE} FROM s")
def score_by_file(spark, sf_dir):
    return score.posture(_deduped(spark, sf_dir), by=("repo", "path"))


def _register_gate(name: str, fail_on: str, condition: str) -> None:
    @query(name, f"WITH {DEDUPED} SELECT repo, bool_or({condition}) AS failed FROM dd GROUP BY repo")
    def gated(spark, sf_dir):
        return score.gate(_deduped(spark, sf_dir), fail_on)


_register_gate("gate_high", "high", "sev >= 3")
_register_gate("gate_never", "never", "false")


@query("findings_per_rule", f"WITH {DEDUPED} SELECT repo, rule_id, count(*) AS findings FROM dd GROUP BY repo, rule_id")
def findings_per_rule(spark, sf_dir):
    return score.by_rule(_deduped(spark, sf_dir))


@query("findings_per_file", f"WITH {DEDUPED} SELECT repo, path, count(*) AS findings, max(sev) AS worst FROM dd GROUP BY repo, path")
def findings_per_file(spark, sf_dir):
    return score.by_file(_deduped(spark, sf_dir))


@query("severity_parse", """WITH v AS (SELECT DISTINCT ' ' || o_orderpriority || ' ' AS t FROM orders UNION SELECT DISTINCT split_part(o_orderpriority, '-', 2) FROM orders
  UNION SELECT DISTINCT lower(split_part(o_orderpriority, '-', 2)) || '  ' FROM orders)
SELECT t AS text, CAST(CASE upper(trim(t)) WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END AS INT) AS level FROM v""")
def severity_parse(spark, sf_dir):
    priority = F.col("o_orderpriority")
    word = F.split(priority, "-")[1]
    texts = F.array(F.concat(F.lit(" "), priority, F.lit(" ")), word, F.concat(F.lower(word), F.lit("  ")))
    return (corpus.table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
            .select(F.explode(texts).alias("text")).distinct().withColumn("level", parse_severity(F.col("text"))))


# ---------------------------------------------------------------- suppression and baseline

_SUPPRESSIONS = [
    Suppression("EVERROR", "d1/f1.py"), Suppression("EVCLICK", "d2/"), Suppression("*", "d3/f3.py", expires="2099-12-31"),
    Suppression("EVVIEW", "d?/f[45].py"), Suppression("EVSIGNUP", "*/f[!0-7].py"), Suppression("EVPURCHASE", "", expires="2025-12-31"),
    Suppression("EVPURCHASE", "d4", expires="2026-01-01"), Suppression("EVERROR", "", expires="2026-1-1"), Suppression("EVERROR", "f2.py"),
    Suppression("*", "", repo="u7"), Suppression("EVCLICK", "*.py", repo="u3", expires="garbage"), Suppression("EVVIEW", "d0/f0.py", repo="u5"),
]
_SUPPRESSED_SQL = """((rule_id = 'EVERROR' AND path = 'd1/f1.py') OR (rule_id = 'EVCLICK' AND path LIKE 'd2/%') OR path = 'd3/f3.py'
  OR (rule_id = 'EVVIEW' AND regexp_matches(path, '^d./f[45]\\.py$')) OR (rule_id = 'EVSIGNUP' AND regexp_matches(path, '/f[^0-7]\\.py$'))
  OR (rule_id = 'EVPURCHASE' AND path LIKE 'd4/%') OR repo = 'u7' OR (repo = 'u5' AND rule_id = 'EVVIEW' AND path = 'd0/f0.py'))"""


@query("config_suppression", f"WITH {DEDUPED} SELECT repo, rule_id, path, line, message, {_SUPPRESSED_SQL} AS suppressed FROM dd")
def config_suppression(spark, sf_dir):
    table = suppress.suppression_table(spark, _SUPPRESSIONS)
    return suppress.split_suppressed(_deduped(spark, sf_dir), table, F.lit(TODAY)).select(
        "repo", "rule_id", "path", "line", "message", "suppressed")


@query("suppressed_counts", f"WITH {DEDUPED} SELECT repo, count(*) AS kept FROM dd WHERE NOT {_SUPPRESSED_SQL} GROUP BY repo")
def suppressed_counts(spark, sf_dir):
    table = suppress.suppression_table(spark, _SUPPRESSIONS)
    return suppress.apply_suppressions(_deduped(spark, sf_dir), table, F.lit(TODAY)).groupBy("repo").agg(
        F.count(F.lit(1)).alias("kept"))


def _dated(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit(datetime.date(2025, 12, 1)), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    text = (F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, F.regexp_replace(day, "-0", "-"))
            .when(F.col("doc_id") % 7 == 2, F.concat(day, F.lit("x"))).otherwise(day))
    return corpus.table(spark, sf_dir, "documents").select(
        F.lit(None).cast("string").alias("repo"), F.lit("*").alias("rule_id"), F.col("doc_id").cast("string").alias("path"),
        F.lit("").alias("reason"), text.alias("expires"))


@query("suppression_expiry", """WITH d AS (SELECT doc_id, strftime(DATE '2025-12-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') AS day FROM documents),
e AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN replace(day, '-0', '-') WHEN 2 THEN day || 'x' ELSE day END AS expires FROM d)
SELECT CAST(doc_id AS VARCHAR) AS path, expires FROM e WHERE expires = '' OR (regexp_matches(expires, '^\\d{4}-\\d{2}-\\d{2}$') AND CAST(expires AS VARCHAR) >= '2026-01-01')""")
def suppression_expiry(spark, sf_dir):
    return suppress.active(_dated(spark, sf_dir), F.lit(TODAY)).select("path", "expires")


def _baseline(spark, sf_dir):
    """Known errors by exact key, known clicks by stable id (with shifted lines)."""
    entries = suppress.baseline_of(_deduped(spark, sf_dir))
    exact = entries.where("rule_id = 'EVERROR' and line < 12").withColumn("stable_id", F.lit(""))
    moved = entries.where("rule_id = 'EVCLICK' and path like 'd1/%'").withColumn("line", F.col("line") + 100)
    return exact.unionByName(moved)


@query("baseline_subtraction", f"""WITH {DEDUPED}, known AS (SELECT DISTINCT repo, {sql.stable()} AS sid FROM dd WHERE rule_id = 'EVCLICK' AND path LIKE 'd1/%')
SELECT repo, rule_id, path, line, message FROM dd WHERE NOT (rule_id = 'EVERROR' AND line < 12)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = dd.repo AND k.sid = {sql.stable()})""")
def baseline_subtraction(spark, sf_dir):
    return suppress.subtract_baseline(_deduped(spark, sf_dir), _baseline(spark, sf_dir)).select(
        "repo", "rule_id", "path", "line", "message")


@query("baseline_entries", f"WITH {DEDUPED} SELECT repo, rule_id, path, line, left(message, 80) AS message80, {sql.stable()} AS stable_id FROM dd")
def baseline_entries(spark, sf_dir):
    return suppress.baseline_of(_deduped(spark, sf_dir))


@query("accept_finding", f"""WITH {DEDUPED}, f AS (SELECT *, {sql.fingerprint()} AS fp FROM dd),
w AS (SELECT repo, min(fp) AS fp FROM f GROUP BY repo), l AS (SELECT repo, max(fp) AS fp FROM f GROUP BY repo)
SELECT f.repo, f.fp AS prefix, CASE WHEN f.rule_id = 'EVVIEW' THEN 'covered' ELSE 'accepted' END AS status, CASE WHEN f.rule_id <> 'EVVIEW' THEN f.rule_id END AS rule_id,
  CASE WHEN f.rule_id <> 'EVVIEW' THEN path END AS path, CASE WHEN f.rule_id <> 'EVVIEW' THEN 'accepted finding (' || f.fp || ')' END AS reason
FROM f JOIN (SELECT * FROM w UNION SELECT * FROM l) x ON f.repo = x.repo AND f.fp = x.fp
UNION ALL SELECT DISTINCT repo, 'zzzzzz', 'unknown', NULL, NULL, NULL FROM dd UNION ALL SELECT DISTINCT repo, 'abc', 'short', NULL, NULL, NULL FROM dd""")
def accept_finding(spark, sf_dir):
    """The lowest and the highest fingerprint of every repository, and two prefixes that name nothing."""
    found = _deduped(spark, sf_dir)
    ends = with_identity(found).groupBy("repo").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    wanted = ends.select("repo", F.explode(F.array("a", "b", F.lit("ZZZZZZ "), F.lit("abc"))).alias("prefix"))
    rules = suppress.suppression_table(spark, [Suppression("EVVIEW", "")])
    return suppress.accept_findings(found, rules, wanted).drop("expires")


@query("one_suppression_per_repository", f"""WITH {DEDUPED} SELECT repo, rule_id, path, line, message,
  (rule_id = 'EVCLICK' OR (path LIKE 'd1/f%' AND regexp_matches(path, '^d1/f[^/]*[.]py$'))) AS suppressed FROM dd""")
def one_suppression_per_repository(spark, sf_dir):
    """A suppression without a path and one with a pattern for every repository."""
    found = _deduped(spark, sf_dir)
    each = found.select("repo").distinct().select("repo", F.explode(F.array(
        F.struct(F.lit("EVCLICK").alias("rule_id"), F.lit("").alias("path")), F.struct(F.lit("*").alias("rule_id"), F.lit("d1/f*.py").alias("path")))).alias("s"))
    rules = each.select("repo", "s.rule_id", "s.path", F.lit("").alias("reason"), F.lit("").alias("expires"))
    return suppress.split_suppressed(found, rules, F.lit(TODAY)).select("repo", "rule_id", "path", "line", "message", "suppressed")


# ---------------------------------------------------------------- diff

def _snapshots(spark, sf_dir):
    """Two overlapping reports: some findings gone, some new, views moved by a line."""
    both = _events(spark, sf_dir).withColumn("stable_id", stable_fingerprint())
    old = both.where("rule_id <> 'EVSIGNUP' or line < 6")
    new = both.where("rule_id <> 'EVERROR' or line > 3").withColumn("line", F.when(
        F.col("rule_id") == "EVVIEW", F.col("line") + 1).otherwise(F.col("line")))
    return old, new


_DIFF_SQL = f"""{sql.EVENT_FINDINGS}, base AS (SELECT *, {sql.stable()} AS stable_id FROM ev),
sides AS (SELECT *, false AS is_new FROM base WHERE rule_id <> 'EVSIGNUP' OR line < 6
  UNION ALL SELECT * REPLACE (CASE WHEN rule_id = 'EVVIEW' THEN line + 1 ELSE line END AS line), true FROM base WHERE rule_id <> 'EVERROR' OR line > 3),
occ AS (SELECT *, row_number() OVER (PARTITION BY repo, stable_id, path, line, message, is_new ORDER BY pos) AS n,
  count(*) FILTER (WHERE is_new) OVER k AS c_new, count(*) FILTER (WHERE NOT is_new) OVER k AS c_old,
  min(CASE WHEN NOT is_new THEN pos END) OVER k AS first_old FROM sides WINDOW k AS (PARTITION BY repo, stable_id, path, line, message)),
rest AS (SELECT * FROM occ WHERE CASE WHEN is_new THEN n > least(c_old, c_new) ELSE n <= c_old - least(c_old, c_new) END),
paired AS (SELECT *, row_number() OVER (PARTITION BY repo, stable_id, is_new ORDER BY CASE WHEN is_new THEN pos ELSE first_old END, pos) AS place,
  least(count(*) FILTER (WHERE is_new) OVER g, count(*) FILTER (WHERE NOT is_new) OVER g) AS pairs FROM rest WINDOW g AS (PARTITION BY repo, stable_id)),
out_rows AS (SELECT *, CASE WHEN is_new THEN 'added' ELSE 'removed' END AS status FROM paired WHERE place > pairs)"""


@query("report_diff_rows", f"WITH {_DIFF_SQL} SELECT status, repo, rule_id, path, line, pos FROM out_rows")
def report_diff_rows(spark, sf_dir):
    # a small block size, so that this query exercises ranking across blocks
    return diff.diff_reports(*_snapshots(spark, sf_dir), block=1000).rows.select("status", "repo", "rule_id", "path", "line", "pos")


@query("report_diff_counts", f"""WITH {_DIFF_SQL},
t AS (SELECT repo, count(*) FILTER (WHERE is_new) AS n_new FROM sides GROUP BY repo),
o AS (SELECT repo, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed FROM out_rows GROUP BY repo)
SELECT t.repo, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, n_new - coalesce(added, 0) AS unchanged FROM t LEFT JOIN o ON t.repo = o.repo""")
def report_diff_counts(spark, sf_dir):
    return diff.diff_reports(*_snapshots(spark, sf_dir)).counts


@query("new_at_or_above_medium", f"WITH {_DIFF_SQL} SELECT repo, rule_id, path, line, pos FROM out_rows WHERE status = 'added' AND sev >= 2")
def new_at_or_above_medium(spark, sf_dir):
    return diff.new_at_or_above(diff.diff_reports(*_snapshots(spark, sf_dir)), severity_level("medium")).select(
        "repo", "rule_id", "path", "line", "pos")


@query("resolved_preview", f"""WITH {_DIFF_SQL}
SELECT severity, rule_id, path, line, pos FROM out_rows WHERE status = 'removed' ORDER BY sev DESC, path, line, message, evidence, pos LIMIT 20""")
def resolved_preview(spark, sf_dir):
    preview, _ = diff.resolved_preview(diff.diff_reports(*_snapshots(spark, sf_dir)))
    return preview.select("severity", "rule_id", "path", "line", "pos")


@query("resolved_beyond_preview", f"""WITH {_DIFF_SQL} SELECT greatest(count(*) - 20, 0) AS more FROM out_rows WHERE status = 'removed'""")
def resolved_beyond_preview(spark, sf_dir):
    return diff.resolved_preview(diff.diff_reports(*_snapshots(spark, sf_dir)))[1]


# ---------------------------------------------------------------- documents

def _lines(df):
    return df.select("repo", "section", "text")


@query("annotation_lines", rf"""WITH {DEDUPED} SELECT repo, '::' || CASE WHEN sev >= 3 THEN 'error' ELSE 'warning' END || ' file=' || path ||
  CASE WHEN line > 0 THEN ',line=' || line ELSE '' END || ',title=' || rule_id || ' ' || title || '::' ||
  replace(left(message || ' [' || evidence || ']', 400), '%', '%25') AS text FROM dd
UNION ALL SELECT DISTINCT 'c' || c_custkey, '::notice::auditlake: no findings' FROM customer""")
def annotation_lines(spark, sf_dir):
    # customers stand for repositories without findings
    quiet = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo"))
    found = _deduped(spark, sf_dir)
    stats = found.select("repo").distinct().unionByName(quiet).withColumn("suppressed", F.lit(0))
    return documents.annotations(found, stats).select("repo", "text")


_ESC = """replace(replace(replace({}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"""


@query("junit_lines", f"""WITH {DEDUPED}, n AS (SELECT repo, rule_id, count(*) AS n FROM dd GROUP BY ALL), t AS (SELECT repo, sum(n) AS n FROM n GROUP BY repo)
SELECT repo, 0::INT AS section, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuites name="auditlake" tests="' || n || '" failures="' || n || '">' AS text FROM t
UNION ALL SELECT repo, 1, '  <testsuite name="auditlake.' || rule_id || '" tests="' || n || '" failures="' || n || '">' FROM n
UNION ALL SELECT repo, 1, '  </testsuite>' FROM n
UNION ALL SELECT repo, 1, '    <testcase name="' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END || '" classname="auditlake.' || rule_id ||
  '"><failure message="' || left(severity || ': ' || message, 300) || '">' || {_ESC.format("left(evidence || chr(10) || 'fix: ' || fix, 800)")} || '</failure></testcase>' FROM dd
UNION ALL SELECT repo, 2, '</testsuites>' FROM t
UNION ALL SELECT 'c' || c_custkey, 0, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuites name="auditlake" tests="1" failures="0">' FROM customer
UNION ALL SELECT 'c' || c_custkey, 1, '  <testsuite name="auditlake" tests="1" failures="0"/>' FROM customer
UNION ALL SELECT 'c' || c_custkey, 2, '</testsuites>' FROM customer""")
def junit_lines(spark, sf_dir):
    found = _deduped(spark, sf_dir)
    quiet = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo"))
    return _lines(documents.junit(found, found.select("repo").unionByName(quiet)))


_RANKED = "row_number() OVER (PARTITION BY repo ORDER BY sev DESC, path, line, rule_id, message) = 1"


def _json(**fields) -> str:
    return " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())


def _str(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


@query("gitlab_lines", f"""WITH {DEDUPED}
SELECT repo, 0::INT AS section, '[' AS text FROM (SELECT DISTINCT repo FROM dd)
UNION ALL SELECT repo, 2, ']' FROM (SELECT DISTINCT repo FROM dd)
UNION ALL SELECT repo, 1, CASE WHEN {_RANKED} THEN '' ELSE ',' END || '{{"type":"issue",' || {_json(check_id=_str('rule_id'), description=_str('message'))} ||
  ',"severity":"' || CASE sev WHEN 4 THEN 'blocker' WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'info' END || '","confidence":"medium","fingerprint":"' || {sql.stable()} ||
  '","location":{{"path":' || {_str('path')} || ',"lines":{{"begin":' || greatest(line, 1) || '}}}}}}' FROM dd""")
def gitlab_lines(spark, sf_dir):
    found = _deduped(spark, sf_dir)
    return _lines(documents.gitlab(found, found))


@query("sarif_lines", f"""WITH {DEDUPED}, f AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY repo, rule_id ORDER BY sev DESC, path, line, message) = 1),
r AS (SELECT DISTINCT repo FROM dd)
SELECT repo, 0::INT AS section, '{{"$schema":"{documents.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"auditlake","rules":[' AS text FROM r
UNION ALL SELECT repo, 2, ']}}}},"results":[' FROM r UNION ALL SELECT repo, 4, ']}}]}}' FROM r
UNION ALL SELECT repo, 1, CASE WHEN {_RANKED} THEN '' ELSE ',' END || '{{' || {_json(id=_str('rule_id'), name=_str('title'))} || ',"shortDescription":{{"text":' || {_str('title')} ||
  '}},"fullDescription":{{"text":' || {_str('message')} || '}},"help":{{"text":' || {_str('fix')} || '}},"properties":{{"security-severity":"' ||
  CASE sev WHEN 4 THEN '9.5' WHEN 3 THEN '8.0' WHEN 2 THEN '5.0' WHEN 1 THEN '2.0' ELSE '0.0' END || '"}}}}' FROM f
UNION ALL SELECT repo, 3, CASE WHEN {_RANKED} THEN '' ELSE ',' END || '{{' || {_json(ruleId=_str('rule_id'))} || ',"level":"' ||
  CASE WHEN sev >= 3 THEN 'error' WHEN sev = 2 THEN 'warning' ELSE 'note' END || '","message":{{"text":' || {_str('message')} ||
  '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || {_str('path')} || '}}' || CASE WHEN line > 0 THEN ',"region":{{"startLine":' || line || '}}' ELSE '' END ||
  '}}}}],"partialFingerprints":{{"auditStable/v1":"' || {sql.stable()} || '"}},"properties":{{"severity":"' || severity || '","cwe":"CWE-1","confidence":"medium"}}}}' FROM dd""")
def sarif_lines(spark, sf_dir):
    found = _deduped(spark, sf_dir)
    return _lines(documents.sarif(found, found))


@query("json_report_lines", f"""WITH {DEDUPED}, {_GROUPS.format(by='', group='repo')}, g AS (SELECT repo, {_GRADE} FROM s)
SELECT repo, 0::INT AS section, '{{"tool":{{"name":"auditlake"}},"root":' || {_str('repo')} || ',"score":' || score || ',"grade":"' || grade || '","counts":{{"CRITICAL":' || "CRITICAL" ||
  ',"HIGH":' || "HIGH" || ',"MEDIUM":' || "MEDIUM" || ',"LOW":' || "LOW" || ',"INFO":' || "INFO" || '}},"files_scanned":' || f.n || ',"files_skipped":0,"suppressed":0,"notes":[' AS text
  FROM g JOIN (SELECT repo, count(DISTINCT path) AS n FROM dd GROUP BY repo) f USING (repo)
UNION ALL SELECT repo, 1, CAST(to_json('scanned ' || repo) AS VARCHAR) FROM s UNION ALL SELECT repo, 2, '],"findings":[' FROM s UNION ALL SELECT repo, 4, ']}}' FROM s
UNION ALL SELECT repo, 3, CASE WHEN {_RANKED} THEN '' ELSE ',' END || '{{' || {_json(id=_str(sql.fingerprint()), stable_id=_str(sql.stable()), rule_id=_str('rule_id'), title=_str('title'),
  severity=_str('severity'), message=_str('message'), path=_str('path'), line='line', evidence=_str('evidence'), fix=_str('fix'), cwe=_str('cwe'), confidence=_str('confidence'))} ||
  ',"scanner":"events"}}' FROM dd""")
def json_report_lines(spark, sf_dir):
    found = _deduped(spark, sf_dir)
    stats = found.groupBy("repo").agg(F.countDistinct("path").alias("files_scanned"), F.lit(0).alias("files_skipped"), F.lit(0).alias("suppressed"))
    notes = stats.select("repo", F.concat(F.lit("scanned "), "repo").alias("note"))
    return _lines(documents.json_report(found, stats, notes))


# ---------------------------------------------------------------- report sources

_JSON_ITEMS = ['{"rule_id": "R@", "path": "a\\\\b.py", "line": 3, "severity": "high", "message": "m@", "evidence": " e@ ", "title": "T"}',
               '{"rule_id": "R@", "line": "7", "severity": "odd", "stable_id": "abc@"}', '{"no_rule": 1}', '{"rule_id": "X", "line": "seven"}', '"text"',
               '{"rule_id": "N", "line": null, "severity": "LOW", "path": "p"}']
_SARIF_ITEMS = ['{"ruleId": "S@", "level": "error", "message": {"text": "t@"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "u@.py"}, "region": {"startLine": 4}}}], "partialFingerprints": {"auditStable/v1": "fp@"}, "properties": {"severity": "critical", "title": "Title"}}',
                '{"ruleId": "S2", "message": "plain @", "level": "note", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "v.py"}, "region": {"startLine": null}}}], "properties": 5}',
                '{"ruleId": "S3", "locations": "bad"}', '{"level": "error"}', '{"ruleId": "S4", "locations": []}']


def _reports(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    plain = '{"findings": [' + ", ".join(_JSON_ITEMS) + "]}"
    sarif = '{"version": "2.1.0", "runs": [{"results": [' + ", ".join(_SARIF_ITEMS) + ']}, {"results": null}, 3, {"results": [' + _SARIF_ITEMS[1] + "]}]}"
    return corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), doc).alias("repo"), F.replace(corpus.pick([plain, sarif, '{"findings": []}', '{"runs": []}'], F.col("doc_id")), F.lit("@"), doc).alias("payload"))


def _sid(rule: str, path: str, evidence: str) -> str:
    return f"substr(sha1({rule} || '|' || {path} || '|' || {evidence}), 1, 12)"


@query("report_sources", f"""WITH d AS (SELECT 'd' || doc_id AS repo, CAST(doc_id AS VARCHAR) AS i, doc_id % 4 AS k FROM documents)
SELECT repo, {_sid("'R' || i", "'a/b.py'", "'e' || i")} AS stable_id, 'R' || i AS rule_id, 'T' AS title, 3::INT AS sev, 'm' || i AS message, 'a\\b.py' AS path, 3::INT AS line, ' e' || i || ' ' AS evidence, 'json' AS scanner, 0::BIGINT AS pos FROM d WHERE k = 0
UNION ALL SELECT repo, 'abc' || i, 'R' || i, '', 2, '', '', 7, '', 'json', 1 FROM d WHERE k = 0
UNION ALL SELECT repo, {_sid("'N'", "'p'", "''")}, 'N', '', 1, '', 'p', 0, '', 'json', 5 FROM d WHERE k = 0
UNION ALL SELECT repo, 'fp' || i, 'S' || i, 'Title', 4, 't' || i, 'u' || i || '.py', 4, '', 'sarif', 0 FROM d WHERE k = 1
UNION ALL SELECT repo, {_sid("'S2'", "'v.py'", "''")}, 'S2', 'S2', 1, 'plain ' || i, 'v.py', 0, '', 'sarif', p FROM d, (VALUES (1), (3 * 4294967296)) x(p) WHERE k = 1
UNION ALL SELECT repo, {_sid("'S4'", "''", "''")}, 'S4', 'S4', 2, '', '', 0, '', 'sarif', 4 FROM d WHERE k = 1""")
def report_sources(spark, sf_dir):
    return reports.load_reports(_reports(spark, sf_dir)).drop("severity")


@query("report_errors", """WITH d AS (SELECT 'd' || doc_id AS repo, text, doc_id % 4 AS k FROM documents)
SELECT repo, CASE k WHEN 0 THEN 'not a findings or SARIF report' WHEN 1 THEN '1 findings but none parseable' END AS error FROM d WHERE k < 2""")
def report_errors(spark, sf_dir):
    """Each document's own text as a broken report, or as the message of a finding whose line no integer holds."""
    text = F.to_json(F.struct(F.col("text").alias("message")))
    kinds = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), "text")).when(
        F.col("doc_id") % 4 == 1, F.concat(F.lit('{"findings": ['), text, F.lit("]}"))).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit('{"findings": [{"rule_id": "R", "line": 99999999999}, {"rule_id": "S", "message": '), text, F.lit("}]}"))).otherwise(
        F.lit('{"findings": []}'))
    return reports.report_errors(corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"), kinds.alias("payload")))


def _baseline_documents(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    texts = ['{"version": 1, "findings": [{"rule_id": "R@", "path": "p", "line": 4, "message": "m@", "stable_id": "s@"}, {"rule_id": "Q"}, 5]}',
             '[{"rule_id": "L", "path": "q@", "message": "' + "x" * 90 + '"}]', '{"findings": [{"path": "p"}]}', "not json", '{"findings": 7}', "{}", '"text"']
    return corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("b"), doc).alias("repo"), F.replace(corpus.pick(texts, F.col("doc_id")), F.lit("@"), doc).alias("payload"))


@query("baseline_sources", """WITH d AS (SELECT 'b' || doc_id AS repo, CAST(doc_id AS VARCHAR) AS i, doc_id % 7 AS k FROM documents)
SELECT repo, 'R' || i AS rule_id, 'p' AS path, 4::INT AS line, 'm' || i AS message80, 's' || i AS stable_id FROM d WHERE k = 0
UNION ALL SELECT repo, 'L', 'q' || i, 0, repeat('x', 80), '' FROM d WHERE k = 1""")
def baseline_sources(spark, sf_dir):
    return reports.load_baselines(_baseline_documents(spark, sf_dir))[0]


@query("baseline_errors", """SELECT 'b' || doc_id AS repo, CASE doc_id % 7 WHEN 2 THEN 'no usable entries' ELSE 'unreadable' END AS error FROM documents WHERE doc_id % 7 IN (2, 3, 4, 6)""")
def baseline_errors(spark, sf_dir):
    return reports.load_baselines(_baseline_documents(spark, sf_dir))[1]


# ---------------------------------------------------------------- the whole scan

_SCAN_SUPPRESSIONS = [Suppression("SEC020", "", repo="src3"), Suppression("SEC023", "src/d1*/*"), Suppression("SEC055", "", expires="2025-12-31")]
_LEVELS = ", ".join(f"('{r.rule_id}', {severity_level(r.severity)})" for r in (*catalog.LINE_RULES, *catalog.FILE_RULES, *SECRET_RULES)) + \
    ", ('SEC041', 3), ('SEC050', 4), ('SEC053', 1), ('SEC070', 2), ('SEC074', 1)"


@query("full_scan", f"""WITH located AS (
  SELECT repo, rule_id, path, line, NULL::INT AS sev FROM ({ORACLES['scan_findings']}) WHERE rule_id NOT LIKE '%-SKIP'
  UNION ALL SELECT DISTINCT 'src' || (CAST(substr(repo, 2) AS INT) % 20), 'SEC055', '<git-history>', 0, 4 FROM ({ORACLES['history_secrets']})
  UNION ALL SELECT d.source, rule_id, path, 0, max(sev) FROM ({ORACLES['audit_report_findings']}) a JOIN documents d ON a.repo = 'a' || d.doc_id
    WHERE rule_id NOT LIKE '%-SKIP' GROUP BY d.source, rule_id, path),
kept AS (SELECT l.*, coalesce(l.sev, v.sev) AS level FROM located l LEFT JOIN (VALUES {_LEVELS}) v(rule_id, sev) ON l.rule_id = v.rule_id
  WHERE NOT (l.rule_id = 'SEC020' AND repo = 'src3') AND NOT (l.rule_id = 'SEC023' AND regexp_matches(path, '^src/d1[^/]*/')))
SELECT repo, rule_id, count(*) AS places, bool_or(level >= 3) AS gating FROM kept GROUP BY repo, rule_id""")
def full_scan(spark, sf_dir):
    """Every check over the whole corpus, history, reports and suppressions included: places and gate per rule."""
    from auditlake.plans.repo_queries import _tool_reports
    from auditlake.plans.scan import scan

    source = F.concat(F.lit("src"), (F.substring("repo", 2, 20).cast("long") % 20).cast("string"))
    of = corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("repo"), "source")
    reports_ = _tool_reports(spark, sf_dir).join(of, "repo").withColumn("repo", F.col("source")).drop("source")
    result = scan(corpus.files(spark, sf_dir), patches=corpus.commit_patches(spark, sf_dir).withColumn("repo", source), tool_reports=reports_,
                  suppressions=suppress.suppression_table(spark, _SCAN_SUPPRESSIONS), today=F.lit(TODAY))
    found = result.findings.where("rule_id not like '%-SKIP'")
    return found.groupBy("repo", "rule_id").agg(F.countDistinct("path", "line").alias("places"), F.bool_or(F.col("sev") >= 3).alias("gating"))
