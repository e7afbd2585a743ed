"""Queries over files: discovery, lines, line rules, secrets, file and state rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.globs import is_excluded
from auditlake.functions.identity import with_identity
from auditlake.functions.masking import entropy, redact
from auditlake.functions.text import decode_utf8, ext_of
from auditlake.operators import catalog, lines, score
from auditlake.operators.file_scan import scan_files
from auditlake.operators.secrets import SECRET_RULES
from auditlake.options import DEFAULT_EXCLUDES, CustomRule, ScanOptions
from auditlake.plans import corpus
from auditlake.plans import oracle_sql as sql
from auditlake.plans.registry import ORACLES, query
from auditlake.sources.files import changed_since, discover, discovery_stats, is_scannable, staged

# ---------------------------------------------------------------- discovery

_DIRS = sorted(p.strip("/") for p in DEFAULT_EXCLUDES if p.endswith("/") and "*" not in p)
_NAMES = sorted(p for p in DEFAULT_EXCLUDES if not p.endswith("/") and "*" not in p)
EXCLUDED_SQL = (
    f"(list_has_any(parts, {sql.q_list(_DIRS)}) OR len(list_filter(parts, lambda s: ends_with(s, '.egg-info'))) > 0 "
    f"OR list_has_any(parts, {sql.q_list(_NAMES)}) "
    "OR ends_with(name, '.min.js') OR ends_with(name, '.min.css') OR ends_with(name, '.map') OR ends_with(name, '.snap'))")
SCANNABLE_SQL = (
    rf"(lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) IN {sql.q_in(catalog.SCANNED_EXTENSIONS)} "
    "OR lower(name) = 'dockerfile' OR starts_with(lower(name), 'dockerfile.') "
    f"OR name IN {sql.q_in(catalog.SCANNED_NAMES)} OR starts_with(name, '.env'))")


@query("file_discovery", f"""WITH {sql.PLACED}
SELECT repo, path, size_bytes FROM placed WHERE NOT {EXCLUDED_SQL} AND {SCANNABLE_SQL}""")
def file_discovery(spark, sf_dir):
    return discover(corpus.placed_files(spark, sf_dir)).select("repo", "path", "size_bytes")


@query("discovery_stats", f"""WITH {sql.PLACED}
SELECT repo, count(*) FILTER (WHERE NOT {EXCLUDED_SQL} AND {SCANNABLE_SQL}) AS files_scanned,
  count(*) FILTER (WHERE {EXCLUDED_SQL}) AS files_skipped
FROM placed GROUP BY repo""")
def stats(spark, sf_dir):
    return discovery_stats(corpus.placed_files(spark, sf_dir))


@query("size_limited_stats", f"""WITH {sql.PLACED}
SELECT repo, count(*) FILTER (WHERE NOT {EXCLUDED_SQL} AND {SCANNABLE_SQL} AND size_bytes <= 1000000) AS files_scanned,
  count(*) FILTER (WHERE {EXCLUDED_SQL} OR ({SCANNABLE_SQL} AND size_bytes > 1000000)) AS files_skipped
FROM placed GROUP BY repo""")
def size_limited_stats(spark, sf_dir):
    return discovery_stats(corpus.placed_files(spark, sf_dir), ScanOptions(max_file_bytes=1_000_000))


def _changed(spark, sf_dir):
    """Labelled documents as changed files, plus entries that name no file."""
    docs = corpus.placed_files(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"/d(\d+)/", 1).cast("long"))
    kinds = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "staged").otherwise("committed")).otherwise("untracked")
    return (corpus.table(spark, sf_dir, "labels").join(docs, "doc_id")
            .select("repo", F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("gone/"), "path"))
                    .when(F.col("doc_id") % 10 == 8, F.concat(F.lit("../"), "path"))
                    .otherwise(F.col("path")).alias("path"), kinds.alias("kind")))


_CHANGED_SQL = f"""{sql.PLACED},
changed AS (SELECT p.repo, CASE WHEN p.doc_id % 10 = 7 THEN 'gone/' || p.path WHEN p.doc_id % 10 = 8 THEN '../' || p.path ELSE p.path END AS path,
  CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'staged' ELSE 'committed' END ELSE 'untracked' END AS kind
  FROM labels l JOIN placed p ON l.doc_id = p.doc_id)"""


@query("changed_since_files", f"""WITH {_CHANGED_SQL}
SELECT DISTINCT p.repo, p.path FROM placed p JOIN changed c ON p.repo = c.repo AND p.path = c.path
WHERE kind IN ('committed', 'uncommitted', 'untracked') AND NOT {EXCLUDED_SQL}""")
def changed_since_files(spark, sf_dir):
    return discover(corpus.placed_files(spark, sf_dir), None, changed_since(_changed(spark, sf_dir))).select("repo", "path")


@query("staged_files", f"""WITH {_CHANGED_SQL}
SELECT DISTINCT p.repo, p.path FROM placed p JOIN changed c ON p.repo = c.repo AND p.path = c.path
WHERE kind = 'staged' AND NOT {EXCLUDED_SQL}""")
def staged_files(spark, sf_dir):
    return discover(corpus.placed_files(spark, sf_dir), None, staged(_changed(spark, sf_dir))).select("repo", "path")


@query("restricted_scan_stats", f"""WITH {_CHANGED_SQL},
listed AS (SELECT DISTINCT repo, path FROM changed WHERE kind IN ('committed', 'untracked')),
judged AS (SELECT l.repo, p.path IS NOT NULL AND NOT {EXCLUDED_SQL} AS ok
  FROM listed l LEFT JOIN placed p ON l.repo = p.repo AND l.path = p.path)
SELECT r.repo, count(*) FILTER (WHERE ok IS TRUE) AS files_scanned, count(*) FILTER (WHERE j.repo IS NOT NULL AND ok IS NOT TRUE) AS files_skipped
FROM (SELECT DISTINCT repo FROM placed) r LEFT JOIN judged j ON r.repo = j.repo GROUP BY r.repo""")
def restricted_scan_stats(spark, sf_dir):
    return discovery_stats(corpus.placed_files(spark, sf_dir), None, changed_since(_changed(spark, sf_dir)))


@query("tracked_files", f"WITH {sql.PLACED} SELECT repo, count(*) AS tracked_files FROM placed WHERE tracked GROUP BY repo")
def tracked_files(spark, sf_dir):
    return corpus.placed_files(spark, sf_dir).where("tracked").groupBy("repo").agg(F.count(F.lit(1)).alias("tracked_files"))


_PATTERNS = ["/src/", "docs/**", "**/d1?/", "*.rb", "lib/core/d*/[a.py", "tests/", "app/**/x/", "web/coverage/d3*/**", "Dockerfile", ""]
_PATTERNS_SQL = r"""(starts_with(path, 'src/') OR starts_with(path, 'docs/')
  OR regexp_matches(path, '(^|/)d1[^/](/|$)') OR ends_with(name, '.rb') OR list_contains(parts, 'tests')
  OR regexp_matches(path, '^app/(.*/)?x(/|$)') OR regexp_matches(path, '^web/coverage/d3[^/]*/') OR list_contains(parts, 'Dockerfile'))"""


@query("exclude_patterns", f"WITH {sql.PLACED} SELECT path, {_PATTERNS_SQL} AS excluded FROM placed")
def exclude_patterns(spark, sf_dir):
    return corpus.placed_files(spark, sf_dir).select("path", is_excluded(F.col("path"), _PATTERNS).alias("excluded"))


@query("extension_classes", f"WITH {sql.PLACED} SELECT path, ext, {SCANNABLE_SQL} AS scannable FROM placed")
def extension_classes(spark, sf_dir):
    return corpus.placed_files(spark, sf_dir).select("path", ext_of(F.col("path")).alias("ext"), is_scannable(F.col("path")).alias("scannable"))


@query("text_decode", "SELECT page_id, length(html) AS chars, sha1(html) AS digest FROM pages")
def text_decode(spark, sf_dir):
    raw = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))
    return corpus.table(spark, sf_dir, "pages").withColumn("text", decode_utf8(raw)).select(
        "page_id", F.length("text").cast("long").alias("chars"), F.sha1(F.encode("text", "UTF-8")).alias("digest"))


# ---------------------------------------------------------------- lines

@query("physical_lines", f"WITH {sql.FILES}, {sql.phys()} SELECT repo, path, line, text FROM phys")
def physical_lines(spark, sf_dir):
    return lines.explode_physical(corpus.files(spark, sf_dir)).select("repo", "path", "line", "text")


@query("logical_lines", f"WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL} SELECT repo, path, line, text FROM logical")
def logical_lines(spark, sf_dir):
    return lines.explode_logical(corpus.files(spark, sf_dir)).select("repo", "path", "line", "text")


# ---------------------------------------------------------------- line rules

def _code_columns(findings):
    return findings.select("repo", "rule_id", "sev", "message", "path", "line", "evidence")


def _register_line_rules(name: str, langs) -> None:
    """One query per language family: its rules over the whole corpus."""
    rules = tuple(r for r in catalog.LINE_RULES if set(r.langs) & set(langs))

    @query(name, f"WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits(rules)}) "
                 f"SELECT {sql.CODE_FINDING} FROM hits")
    def family(spark, sf_dir):
        return _code_columns(scan_files(
            corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False), line_rules=rules, file_rules=(),
            state_rules_on=False, secret_rules=()))


for _name, _langs in {
    "line_rules_python": catalog.PY, "line_rules_javascript_web": catalog.JS + catalog.WEB,
    "line_rules_shell_yaml_config": catalog.SHELL + catalog.YAML + catalog.CONFIG + catalog.MARKDOWN,
    "line_rules_go": catalog.GO, "line_rules_java": catalog.JAVA, "line_rules_ruby": catalog.RB,
    "line_rules_php": catalog.PHP, "line_rules_csharp": catalog.CS, "line_rules_native": catalog.NATIVE,
    "line_rules_docker": catalog.DOCKER,
}.items():
    _register_line_rules(_name, _langs)


@query("rule_metadata_join", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()})
SELECT rule_id, title, cwe, confidence, fix, count(*) AS findings FROM hits GROUP BY ALL""")
def rule_metadata_join(spark, sf_dir):
    found = scan_files(corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False), file_rules=(),
                       state_rules_on=False, secret_rules=())
    return found.groupBy("rule_id", "title", "cwe", "confidence", "fix").agg(F.count(F.lit(1)).alias("findings"))


# ---------------------------------------------------------------- secrets

_SECRET_SQL = f"""WITH {sql.FILES}, {sql.phys()}, {sql.secret_values('phys')},
hits AS (SELECT *, {sql.redact('v')} AS shown FROM secret_values)"""


@query("secret_findings", f"""{_SECRET_SQL}
SELECT repo, rule_id, CAST(sev AS INT) AS sev, title || ': ' || shown AS message, path, line, shown AS evidence FROM hits""")
def secret_findings(spark, sf_dir):
    return _code_columns(scan_files(corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False),
                                    line_rules=(), file_rules=(), state_rules_on=False))


_ALLOW = ["hunter2", "wz", "a1b2c3d4e5f6"]
_ALLOW_SQL = " OR ".join(f"contains(lower(v), {sql.q(a)}) OR contains(lower(shown), {sql.q(a)}) "
                         f"OR contains(lower(title), {sql.q(a)})" for a in _ALLOW)


@query("secret_allow_list", f"""{_SECRET_SQL}
SELECT repo, rule_id, path, line, shown AS evidence FROM hits WHERE NOT ({_ALLOW_SQL})""")
def secret_allow_list(spark, sf_dir):
    return scan_files(corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False, allow_secrets=_ALLOW),
                      line_rules=(), file_rules=(), state_rules_on=False).select(
        "repo", "rule_id", "path", "line", "evidence")


@query("value_entropy", """WITH v AS (SELECT DISTINCT p_name AS value FROM part WHERE p_name <> ''),
c AS (SELECT value, ch, count(*) AS k FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM v) GROUP BY value, ch)
SELECT value, round(-sum((k / length(value)) * log2(k / length(value))), 6) AS bits FROM c GROUP BY value""")
def value_entropy(spark, sf_dir):
    return (corpus.table(spark, sf_dir, "part").where("p_name <> ''").select(F.col("p_name").alias("value")).distinct()
            .select("value", F.round(entropy("value"), 6).alias("bits")))


@query("value_redaction", f"""WITH v AS (SELECT c_custkey AS id, c_name AS v FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, left(c_name, c_custkey % 19) FROM customer)
SELECT id, v AS value, {sql.redact('v')} AS shown FROM v""")
def value_redaction(spark, sf_dir):
    customer = corpus.table(spark, sf_dir, "customer")
    values = F.array("c_name", "c_mktsegment", F.left(F.col("c_name"), (F.col("c_custkey") % 19).cast("int")))
    return customer.select(F.col("c_custkey").alias("id"), F.explode(values).alias("value")).withColumn(
        "shown", redact(F.col("value")))


# ---------------------------------------------------------------- whole-file and state rules

@query("file_rules", rf"""WITH {sql.FILES}, y AS (SELECT * FROM files WHERE ext IN ('.yml', '.yaml'))
SELECT repo, 'SEC038' AS rule_id, 4::INT AS sev, path, 0::INT AS line FROM y
WHERE regexp_matches(text, '(?im)^\s*pull_request_target\s*:') AND regexp_matches(text, '(?i)uses:\s*\S*actions/checkout')
UNION ALL
SELECT DISTINCT repo, 'SEC039', 2::INT, path, 0::INT FROM (
  SELECT repo, path, unnest(string_split(text, chr(10))) AS l FROM y)
WHERE regexp_matches(l, '(?i)uses:\s*[\w.\-]+/[\w.\-]+@[^\s`]*\s*$')
  AND NOT regexp_matches(l, '(?i)uses:\s*(actions/|github/)') AND NOT regexp_matches(l, '(?i)\b[0-9a-f]{{40}}\s*$')""")
def file_rules(spark, sf_dir):
    return scan_files(corpus.files(spark, sf_dir), line_rules=(), secret_rules=(), state_rules_on=False).select(
        "repo", "rule_id", "sev", "path", "line")


_STATE = dict(line_rules=(), secret_rules=(), file_rules=())


@query("workflow_script_injection", rf"""WITH {sql.FILES}, {sql.phys()},
y AS (SELECT *, {sql.strip('text')} AS bare, length(text) - length(regexp_replace(text, '^\s+', '')) AS indent,
    regexp_matches(text, '^\s*-?\s*run\s*:\s*[|>][-+]?\s*$') AS opens,
    regexp_matches(text, '\$\{{\{{\s*(?:github\.event\.[A-Za-z0-9_.]+|github\.head_ref)\b') AS untrusted
  FROM phys WHERE ext IN ('.yml', '.yaml')),
b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY repo, path ORDER BY line) AS block FROM y WHERE NOT starts_with(bare, '#')),
w AS (SELECT *, first_value(indent) OVER (PARTITION BY repo, path, block ORDER BY line) AS base,
    min(CASE WHEN bare <> '' AND NOT opens THEN indent END) OVER (PARTITION BY repo, path, block ORDER BY line
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM b)
SELECT repo, path, line, left(bare, 160) AS evidence FROM w
WHERE untrusted AND ((block > 0 AND NOT opens AND (low IS NULL OR low > base)) OR (NOT opens AND regexp_matches(text, '^\s*-?\s*run\s*:')))""")
def workflow_script_injection(spark, sf_dir):
    return scan_files(corpus.files(spark, sf_dir), **_STATE).where("rule_id = 'SEC041'").select(
        "repo", "path", "line", "evidence")


@query("dockerfile_untagged_image", rf"""WITH {sql.FILES}, {sql.phys()},
f AS (SELECT *, regexp_extract(text, {sql.q(r'(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?\s*$')}, 1) AS image,
    lower(regexp_extract(text, {sql.q(r'(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?\s*$')}, 2)) AS stage
  FROM phys WHERE ext = '.dockerfile' AND regexp_matches(text, {sql.q(r'(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?\s*$')}))
SELECT repo, path, line, 'FROM ' || image || ' resolves to a moving target (implicit :latest) — builds are not reproducible.' AS message
FROM f WHERE lower(image) <> 'scratch' AND NOT contains(image, '$') AND NOT contains(image, '@')
  AND NOT contains(string_split(image, '/')[-1], ':')
  AND NOT EXISTS (SELECT 1 FROM f s WHERE s.repo = f.repo AND s.path = f.path AND s.line <= f.line AND s.stage = lower(f.image))""")
def dockerfile_untagged_image(spark, sf_dir):
    return scan_files(corpus.files(spark, sf_dir), **_STATE).where("rule_id = 'SEC070'").select(
        "repo", "path", "line", "message")


# ---------------------------------------------------------------- custom rules

_CUSTOM = [
    CustomRule("CORP001", "License line", "LOW", r"[Ll]icen[sc]ed? ", fix="Keep the notice.", extensions=(".py", ".js", ".go"), cwe="CWE-1"),
    CustomRule("CORP002", "Mail address", "MEDIUM", r"[a-z0-9._]+@[a-z0-9.]*example\.(com|org|net)", message="A mail address stands here."),
    CustomRule("CORP003", "Inline script", "HIGH", r"<script>", extensions=(".html",), confidence="medium"),
]


def _text_and_pages(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages").select(
        F.lit("web").alias("repo"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("text"))
    return corpus.files(spark, sf_dir).select("repo", "path", "text").unionByName(pages)


def _custom_sql(rule: CustomRule) -> str:
    gate = "true" if rule.extensions is None else f"ext IN {sql.q_in(rule.extensions)}"
    message = sql.q(rule.message) if rule.message else f"{sql.q(rule.title + ': ')} || left({sql.strip('text')}, 120)"
    return (f"SELECT repo, {sql.q(rule.id)} AS rule_id, {sql.q(rule.severity)} AS severity, {message} AS message, path, line, "
            f"left({sql.strip('text')}, 160) AS evidence, {sql.q(rule.confidence)} AS confidence, 'custom' AS scanner "
            f"FROM phys WHERE {gate} AND ext <> '.lock' AND regexp_matches(text, {sql.q(rule.pattern)})")


@query("custom_rules", f"""WITH {sql.FILES}, both_kinds AS (SELECT repo, path, ext, text FROM files
  UNION ALL SELECT 'web', 'p' || page_id || '.html', '.html', html FROM pages), {sql.phys('both_kinds')}
{" UNION ALL ".join(_custom_sql(r) for r in _CUSTOM)}""")
def custom_rules(spark, sf_dir):
    return scan_files(_text_and_pages(spark, sf_dir), ScanOptions(custom_rules=list(_CUSTOM), inline_suppressions=False),
                      line_rules=(), file_rules=(), state_rules_on=False, secret_rules=()).select(
        "repo", "rule_id", "severity", "message", "path", "line", "evidence", "confidence", "scanner")


# ---------------------------------------------------------------- inline suppression

_MARK = r"(?i)\baudit-ignore(-next-line)?(?:\s+([A-Za-z0-9_*,]+(?:\s*,\s*[A-Za-z0-9_*]+)*))?"
MARKS_SQL = rf"""marks AS (
  SELECT repo, path, line + CASE WHEN following <> '' THEN 1 ELSE 0 END AS line,
    CASE WHEN len(list_filter(toks, lambda t: t <> '*')) = 0 THEN ['*']
      ELSE list_transform(list_filter(toks, lambda t: regexp_matches(t, '^[A-Za-z]{{2,10}}\d{{2,5}}$')), lambda t: upper(t)) END AS ids
  FROM (SELECT repo, path, line, regexp_extract(tail, {sql.q(_MARK)}, 1) AS following,
      list_filter(regexp_split_to_array(regexp_extract(tail, {sql.q(_MARK)}, 2), '[,\s]+'), lambda t: t <> '') AS toks
    FROM (SELECT repo, path, line, substr(text, least(
        CASE WHEN instr(text, '#') = 0 THEN 1000000000 ELSE instr(text, '#') END,
        CASE WHEN instr(text, '//') = 0 THEN 1000000000 ELSE instr(text, '//') END)) AS tail
      FROM phys WHERE regexp_matches(text, '(?i)audit-ignore')) WHERE regexp_matches(tail, {sql.q(_MARK)})))"""
_INLINE_SQL = f"""{MARKS_SQL},
all_hits AS (SELECT repo, rule_id, path, line, ext FROM hits UNION ALL SELECT repo, rule_id, path, line, ext FROM secret_values)"""


@query("inline_suppression", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()}),
{sql.secret_values('phys')}, {_INLINE_SQL}
SELECT h.repo, h.rule_id, h.path, h.line, EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.path = h.path AND m.line = h.line
  AND (list_contains(m.ids, '*') OR list_contains(m.ids, h.rule_id))) AS ignored FROM all_hits h""")
def inline_suppression(spark, sf_dir):
    return scan_files(corpus.files(spark, sf_dir), file_rules=(), state_rules_on=False).select(
        "repo", "rule_id", "path", "line", "ignored")


# ---------------------------------------------------------------- catalog and identity

@query("rule_coverage", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()}),
{sql.secret_values('phys')}, found AS (SELECT rule_id FROM hits UNION ALL SELECT rule_id FROM secret_values),
rules AS (SELECT unnest({sql.q_list([r.rule_id for r in SECRET_RULES + catalog.LINE_RULES])}) AS rule_id)
SELECT r.rule_id, count(f.rule_id) AS findings FROM rules r LEFT JOIN found f ON r.rule_id = f.rule_id GROUP BY r.rule_id""")
def rule_coverage(spark, sf_dir):
    found = scan_files(corpus.files(spark, sf_dir), file_rules=(), state_rules_on=False).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("findings"))
    known = catalog.catalog(spark).where(F.col("kind").isin("secret", "code") & F.col("pattern").isNotNull())
    return known.select("rule_id").join(found, "rule_id", "left").na.fill(0)


@query("finding_fingerprints", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()}),
f AS (SELECT {sql.CODE_FINDING} FROM hits)
SELECT repo, rule_id, path, line, {sql.fingerprint()} AS fingerprint, {sql.stable()} AS stable_fingerprint FROM f""")
def finding_fingerprints(spark, sf_dir):
    found = scan_files(corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False), file_rules=(),
                       state_rules_on=False, secret_rules=())
    return with_identity(found).select("repo", "rule_id", "path", "line", "fingerprint", "stable_fingerprint")


@query("repository_posture", f"""{_SECRET_SQL}, s AS (SELECT repo, count(*) AS findings, sum(CASE sev WHEN 4 THEN 25 ELSE 10 END) AS d, max(sev) AS worst,
  count(*) FILTER (WHERE sev = 4) AS "CRITICAL", count(*) FILTER (WHERE sev = 3) AS "HIGH" FROM (
    SELECT DISTINCT repo, rule_id, path, line, shown, sev FROM hits) GROUP BY repo)
SELECT r.repo, CAST(greatest(0, 100 - coalesce(d, 0)) AS INT) AS score, coalesce(findings, 0) AS findings,
  coalesce("CRITICAL", 0) AS "CRITICAL", coalesce("HIGH", 0) AS "HIGH",
  CASE WHEN 100 - coalesce(d, 0) >= 80 AND worst = 4 THEN 'D' WHEN 100 - coalesce(d, 0) >= 90 THEN 'A' WHEN 100 - d >= 80 THEN 'B'
    WHEN 100 - d >= 70 THEN 'C' WHEN 100 - d >= 50 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT DISTINCT source AS repo FROM documents) r LEFT JOIN s ON r.repo = s.repo""")
def repository_posture(spark, sf_dir):
    from auditlake.operators.findings import dedupe
    found = dedupe(scan_files(corpus.files(spark, sf_dir), ScanOptions(inline_suppressions=False),
                              line_rules=(), file_rules=(), state_rules_on=False))
    return score.posture(found, corpus.files(spark, sf_dir)).select("repo", "score", "findings", "CRITICAL", "HIGH", "grade")


# ---------------------------------------------------------------- the plan as a whole

@query("scan_findings", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()}),
{sql.secret_values('phys')}, {_INLINE_SQL},
live AS (SELECT repo, rule_id, path, line FROM all_hits h WHERE NOT ends_with(path, '/poetry.lock') AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.path = h.path
  AND m.line = h.line AND (list_contains(m.ids, '*') OR list_contains(m.ids, h.rule_id))))
SELECT DISTINCT * FROM (SELECT * FROM live
  UNION ALL SELECT repo, rule_id, path, line FROM ({ORACLES['file_rules']})
  UNION ALL SELECT repo, 'SEC041', path, line FROM ({ORACLES['workflow_script_injection']})
  UNION ALL SELECT repo, 'SEC070', path, line FROM ({ORACLES['dockerfile_untagged_image']})
  UNION ALL SELECT repo, 'SEC050', path, 0 FROM files WHERE tracked AND regexp_matches(path, '/\\.env$')
  UNION ALL SELECT repo, 'SEC053', '.gitignore', 0 FROM files WHERE tracked AND regexp_matches(path, '/\\.env$')
  UNION ALL SELECT repo, 'SEC074', '.dockerignore', 0 FROM files WHERE ext = '.dockerfile'
  UNION ALL SELECT repo, 'GIT-SKIP', '-', 0 FROM files UNION ALL SELECT repo, 'DEPS-SKIP', '-', 0 FROM files)""")
def scan_findings(spark, sf_dir):
    """The findings of ``scan`` over the corpus: file pass, repository checks, deduplication."""
    from auditlake.plans.scan import scan
    return scan(corpus.files(spark, sf_dir)).findings.select("repo", "rule_id", "path", "line").distinct()


@query("scan_statistics", f"""WITH RECURSIVE {sql.FILES}, {sql.phys()}, {sql.LOGICAL}, hits AS ({sql.line_hits()}),
{sql.secret_values('phys')}, {_INLINE_SQL},
quiet AS (SELECT repo FROM all_hits h WHERE EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.path = h.path
  AND m.line = h.line AND (list_contains(m.ids, '*') OR list_contains(m.ids, h.rule_id))))
SELECT f.repo, n - k AS files_scanned, k AS files_skipped, coalesce(s, 0) AS suppressed
FROM (SELECT repo, count(*) AS n, count(*) FILTER (WHERE ends_with(path, '/poetry.lock')) AS k FROM files GROUP BY repo) f
LEFT JOIN (SELECT repo, count(*) AS s FROM quiet GROUP BY repo) q ON f.repo = q.repo""")
def scan_statistics(spark, sf_dir):
    from auditlake.plans.scan import scan
    return scan(corpus.files(spark, sf_dir)).stats
