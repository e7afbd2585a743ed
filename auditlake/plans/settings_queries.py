"""Queries with settings per repository (which of four a source has follows from its name), and of a scan by content."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from auditlake.operators import score
from auditlake.operators.content_cache import ContentCache
from auditlake.operators.file_scan import scan_files
from auditlake.operators.settings import RepoSettings
from auditlake.options import CustomRule, ScanOptions
from auditlake.plans import corpus
from auditlake.plans import oracle_sql as sql
from auditlake.plans.file_queries import EXCLUDED_SQL, MARKS_SQL, SCANNABLE_SQL
from auditlake.plans.registry import query
from auditlake.session import shared_dir
from auditlake.sources.files import discover

# Two repositories use one id for different rules; the third one's first pattern cannot be compiled.
_LOW = CustomRule("OWN001", "Evaluated text", "LOW", r"eval\(", extensions=(".py",))
_HIGH = CustomRule("OWN001", "Made hash", "HIGH", r"[Mm]d5", message="A hash of this kind stands here.")
_ANY = CustomRule("OWN003", "Private import", "MEDIUM", r"__[a-z]+__", extensions=(".py", ".js"))
_ALLOW = ("akia", "hf_")
_MOST = 1500


def _rule(rule: CustomRule) -> dict:
    listed = {} if rule.extensions is None else {"extensions": [e.removeprefix(".") for e in rule.extensions]}
    return {"id": rule.id, "title": rule.title, "severity": rule.severity.lower(), "pattern": rule.pattern, "message": rule.message} | listed


SETTINGS = {
    1: {"exclude": ["src/d1*/"], "custom_rules": [_rule(_LOW)], "fail_on": "critical"},
    2: {"allow_secrets": ["AKIA", "hf_"], "max_file_bytes": _MOST, "custom_rules": [_rule(_HIGH)], "fail_on": "never", "colour": "red"},
    3: {"inline_suppressions": False, "custom_rules": [{"id": "OWN002", "pattern": "(open"}, _rule(_ANY)], "fail_on": "low"},
}


def _settings(spark, sf_dir) -> RepoSettings:
    number = F.ascii(F.right("source", F.lit(1))) % 4
    texts = F.create_map(*[F.lit(x) for pair in ((k, json.dumps(v)) for k, v in SETTINGS.items()) for x in pair])
    sources = corpus.table(spark, sf_dir, "documents").select("source").distinct()
    return RepoSettings(sources.select(F.col("source").alias("repo"), texts[number].alias("settings")).where("settings is not null"))


def _custom_sql(rule: CustomRule, setting: int) -> str:
    gate = "true" if rule.extensions is None else f"ext IN {sql.q_in(rule.extensions)}"
    return (f"SELECT repo, s, {sql.q(rule.id)} AS rule_id, {sql.q(rule.severity)} AS severity, path, line FROM phys2 "
            f"WHERE s = {setting} AND {gate} AND ext <> '.lock' AND regexp_matches(text, {sql.q(rule.pattern)})")


_ALLOWED = " OR ".join(f"contains(lower(v), {sql.q(a)}) OR contains(lower(shown), {sql.q(a)}) OR contains(lower(title), {sql.q(a)})" for a in _ALLOW)
_FOUND = f"""WITH {sql.FILES}, placed AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/') AS parts, ascii(right(repo, 1)) % 4 AS s FROM files),
chosen AS (SELECT repo, path, ext, text FROM placed WHERE NOT {EXCLUDED_SQL} AND {SCANNABLE_SQL}
  AND NOT (s = 1 AND starts_with(path, 'src/d1')) AND NOT (s = 2 AND octet_length(encode(text)) > {_MOST})),
{sql.phys('chosen')}, phys2 AS (SELECT *, ascii(right(repo, 1)) % 4 AS s FROM phys), {sql.secret_values('phys')}, {MARKS_SQL},
found AS ({_custom_sql(_LOW, 1)} UNION ALL {_custom_sql(_HIGH, 2)} UNION ALL {_custom_sql(_ANY, 3)}
  UNION ALL SELECT repo, s, rule_id, CASE sev WHEN 4 THEN 'CRITICAL' ELSE 'HIGH' END, path, line FROM (
    SELECT *, ascii(right(repo, 1)) % 4 AS s, {sql.redact('v')} AS shown FROM secret_values) WHERE NOT (s = 2 AND ({_ALLOWED}))),
judged AS (SELECT *, s <> 3 AND EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.path = h.path AND m.line = h.line
  AND (list_contains(m.ids, '*') OR list_contains(m.ids, h.rule_id))) AS ignored FROM found h)"""


def _scanned(spark, sf_dir, settings):
    return scan_files(discover(corpus.files(spark, sf_dir), settings), settings, line_rules=(), file_rules=(), state_rules_on=False)


@query("settings_per_repository", f"{_FOUND} SELECT repo, rule_id, severity, path, line, ignored FROM judged")
def settings_per_repository(spark, sf_dir):
    return _scanned(spark, sf_dir, _settings(spark, sf_dir)).select("repo", "rule_id", "severity", "path", "line", "ignored")


@query("gate_per_repository", f"""{_FOUND}, levels AS (SELECT DISTINCT source AS repo, ascii(right(source, 1)) % 4 AS s FROM documents),
worst AS (SELECT repo, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst FROM judged WHERE NOT ignored GROUP BY repo)
SELECT l.repo, coalesce(worst >= CASE l.s WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 3 THEN 1 END, false) AS failed FROM levels l LEFT JOIN worst w ON l.repo = w.repo""")
def gate_per_repository(spark, sf_dir):
    settings = _settings(spark, sf_dir)
    repos = corpus.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"))
    return score.gate_by_level(_scanned(spark, sf_dir, settings).where("not ignored"), settings.gate_levels(repos))


@query("setting_notes", """WITH r AS (SELECT DISTINCT source AS repo, ascii(right(source, 1)) % 4 AS s FROM documents)
SELECT repo, 'setting ''colour'' is not known' AS note FROM r WHERE s = 2
UNION ALL SELECT repo, 'custom rule OWN002 left out: it has a pattern the engine rejects' FROM r WHERE s = 3""")
def setting_notes(spark, sf_dir):
    return _settings(spark, sf_dir).notes


@query("rescan_unchanged", f"""WITH {sql.FILES}, {sql.phys()}, {sql.secret_values('phys')}
SELECT repo, rule_id, 'moved/' || path AS path, line, title || ': ' || {sql.redact('v')} AS message, 0::BIGINT AS texts_scanned FROM secret_values""")
def rescan_unchanged(spark, sf_dir):
    """All files are scanned, then moved and scanned again: the second scan reads its findings from the first."""
    cache = ContentCache(spark, f"{shared_dir(spark)}/auditlake/contents-{uuid.uuid4().hex}")
    files = corpus.files(spark, sf_dir)
    options, secrets_only = ScanOptions(inline_suppressions=False), {"line_rules": (), "file_rules": (), "state_rules_on": False}
    cache.scan(files, options, **secrets_only)
    again = cache.scan(files.withColumn("path", F.concat(F.lit("moved/"), "path")), options, **secrets_only)
    return again.select("repo", "rule_id", "path", "line", "message", F.lit(cache.scanned).cast("long").alias("texts_scanned"))
