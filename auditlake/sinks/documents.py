"""Report documents as ordered lines.

A repository can hold any number of findings, so no document is built in one cell: every
finding renders to its own line and a sort key puts the lines of a document in order. The
first element of each JSON list is found by a map-side-combined minimum and gets no comma.
``write_documents`` range-partitions by that key; the part files of a repository,
concatenated by name, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.identity import with_identity
from auditlake.functions.severity import SEVERITIES, label_to, severity_level
from auditlake.functions.text import posix
from auditlake.operators import score

TOOL_NAME = "auditlake"

# Severity maps and limits of the output formats.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.0", "LOW": "2.0", "INFO": "0.0"}
GITLAB_SEVERITY = {"CRITICAL": "blocker", "HIGH": "major", "MEDIUM": "minor", "LOW": "info", "INFO": "info"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
STABLE_PRINT = "auditStable/v1"
ANNOTATION_MAX, JUNIT_MESSAGE_MAX, JUNIT_BODY_MAX = 400, 300, 800
XML_INVALID = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Report order inside one repository; unique per deduplicated finding.
ORDER = ["neg_sev", "path", "line", "scan_seq", "rule_id", "message"]
LINE = ["repo", "section", "key", "text"]


def _named(column: Column, table: dict[str, str]) -> Column:
    return label_to(column, table, F.lit(None).cast("string"))


def _prepared(findings: DataFrame) -> DataFrame:
    return with_identity(findings).withColumn("neg_sev", -F.col("sev"))


def _said() -> Column:
    """What a document shows as the message: the title where a finding has none."""
    return F.when(F.coalesce("message", F.lit("")) != "", F.col("message")).otherwise(F.col("title"))


def _key() -> Column:
    return F.struct(*ORDER)


def _null_key() -> Column:
    return F.struct(F.lit(None).cast("int").alias("neg_sev"), F.lit(None).cast("string").alias("path"),
                    F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("scan_seq"),
                    F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("message"))


def _json_items(items: DataFrame, section: int) -> DataFrame:
    """Lines of a JSON list: a comma leads every element but the first of its repository.

    Equal elements are counted and spelled out again, so that exactly one of them can be the first.
    """
    counted = items.groupBy("repo", "key", "text").agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy("repo").agg(F.min(F.struct("key", "text")).alias("f")).select(
        "repo", "f.key", "f.text", F.lit(True).alias("first"))
    # joined on the full key: a large repository spreads over its findings
    return (counted.join(first, ["repo", "key", "text"], "left")
            .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            .select("repo", F.lit(section).alias("section"), "key",
                    F.concat(F.when(F.col("first") & (F.col("copy") == 1), "").otherwise(","), "text").alias("text")))


def _fixed_line(repos: DataFrame, section: int, text: Column) -> DataFrame:
    return repos.select("repo", F.lit(section).alias("section"), _null_key().alias("key"), text.alias("text"))


def _json_text(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def json_report(findings: DataFrame, stats: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One JSON report per repository of ``stats``; ``notes`` holds one row per repository and note."""
    rows = _prepared(findings)
    items = rows.select("repo", _key().alias("key"), _json_text(F.struct(
        F.col("fingerprint").alias("id"), F.col("stable_fingerprint").alias("stable_id"), "rule_id", "title",
        "severity", "message", "path", "line", "evidence", "fix", "cwe", "confidence", "scanner")).alias("text"))
    heads = stats.join(score.posture(findings, stats), "repo")
    counts = F.struct(*[F.col(s) for s in reversed(SEVERITIES)])
    head = F.concat(F.lit('{"tool":{"name":"' + TOOL_NAME + '"},"root":'), _quoted(F.col("repo")),
                    F.lit(',"score":'), F.col("score").cast("string"), F.lit(',"grade":"'), "grade",
                    F.lit('","counts":'), _json_text(counts),
                    F.lit(',"files_scanned":'), F.col("files_scanned").cast("string"),
                    F.lit(',"files_skipped":'), F.col("files_skipped").cast("string"),
                    F.lit(',"suppressed":'), F.col("suppressed").cast("string"), F.lit(',"notes":['))
    parts = [_fixed_line(heads, 0, head), _fixed_line(heads, 2, F.lit('],"findings":[')),
             _json_items(items, 3), _fixed_line(heads, 4, F.lit("]}"))]
    if notes is not None:
        numbered = notes.where("repo is not null").select("repo", "note").distinct().select("repo", F.struct(
            F.lit(0).alias("neg_sev"), F.lit("").alias("path"), F.lit(0).alias("line"),
            F.lit(0).alias("scan_seq"), F.lit("").alias("rule_id"), F.col("note").alias("message")).alias("key"),
            _quoted(F.col("note")).alias("text"))
        parts.insert(1, _json_items(numbered, 1))
    return _union(parts)


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def sarif(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """SARIF 2.1.0 per repository; a rule's metadata comes from its first finding."""
    rows = _prepared(findings)
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(
        F.struct(posix(F.col("path")).alias("uri")).alias("artifactLocation"),
        region.alias("region")).alias("physicalLocation"))
    results = rows.select("repo", _key().alias("key"), F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), _named(F.col("severity"), SARIF_LEVEL).alias("level"),
        F.struct(_said().alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.create_map(F.lit(STABLE_PRINT), "stable_fingerprint").alias("partialFingerprints"),
        F.struct("severity", "cwe", "confidence").alias("properties"))).alias("text"))

    first = rows.groupBy("repo", "rule_id").agg(
        F.min(F.struct(*ORDER, "title", "fix", "severity")).alias("f"))
    title, fix = F.col("f.title"), F.col("f.fix")
    rules = first.select("repo", F.struct(*[F.col(f"f.{c}").alias(c) for c in ORDER]).alias("key"), F.to_json(F.struct(
        F.col("rule_id").alias("id"), title.alias("name"), F.struct(title.alias("text")).alias("shortDescription"),
        F.struct(F.when(F.col("f.message") != "", F.col("f.message")).otherwise(title).alias("text")).alias("fullDescription"),
        F.struct(F.when(fix != "", fix).otherwise(title).alias("text")).alias("help"),
        F.create_map(F.lit("security-severity"), _named(F.col("f.severity"), SECURITY_SEVERITY)).alias("properties")
    )).alias("text"))
    head = ('{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"'
            + TOOL_NAME + '","rules":[')
    ids = repos.select("repo").distinct()
    return _union([_fixed_line(ids, 0, F.lit(head)), _json_items(rules, 1),
                   _fixed_line(ids, 2, F.lit(']}},"results":[')), _json_items(results, 3),
                   _fixed_line(ids, 4, F.lit("]}]}"))])


def gitlab(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """GitLab Code Quality list per repository."""
    items = _prepared(findings).select("repo", _key().alias("key"), F.to_json(F.struct(
        F.lit("issue").alias("type"), F.col("rule_id").alias("check_id"), _said().alias("description"),
        _named(F.col("severity"), GITLAB_SEVERITY).alias("severity"),
        F.when(F.col("confidence").isin("low", "medium", "high"), F.col("confidence")).otherwise("medium").alias("confidence"),
        F.col("stable_fingerprint").alias("fingerprint"),
        F.struct(posix(F.col("path")).alias("path"), F.struct(
            F.greatest("line", F.lit(1)).alias("begin")).alias("lines")).alias("location"))).alias("text"))
    ids = repos.select("repo").distinct()
    return _union([_fixed_line(ids, 0, F.lit("[")), _json_items(items, 1), _fixed_line(ids, 2, F.lit("]"))])


def _escape_annotation(text: Column, prop: bool = False) -> Column:
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")) + (((":", "%3A"), (",", "%2C")) if prop else ()):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def annotation_text() -> Column:
    """One CI annotation per finding."""
    props = F.concat_ws(",", F.concat(F.lit("file="), _escape_annotation(posix(F.col("path")), True)),
                        F.when(F.col("line") > 0, F.concat(F.lit("line="), F.col("line").cast("string"))),
                        F.concat(F.lit("title="), _escape_annotation(F.concat("rule_id", F.lit(" "), "title"), True)))
    body = F.concat(_said(), F.when(F.col("evidence") != "", F.concat(F.lit(" ["), "evidence", F.lit("]"))).otherwise(""))
    command = F.when(F.col("sev") >= severity_level("HIGH"), "error").otherwise("warning")
    return F.concat(F.lit("::"), command, F.lit(" "), props, F.lit("::"),
                    _escape_annotation(F.substring(body, 1, ANNOTATION_MAX)))


def annotations(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """Annotation lines; a notice for repositories with neither findings nor suppressions."""
    lines = _prepared(findings).select("repo", F.lit(0).alias("section"), _key().alias("key"), annotation_text().alias("text"))
    silent = (stats.where(F.coalesce("suppressed", F.lit(0)) == 0).select("repo").distinct()
              .join(findings.select("repo").distinct(), "repo", "left_anti"))
    return _union([lines, _fixed_line(silent, 0, F.lit(f"::notice::{TOOL_NAME}: no findings"))])


def _xml(text: Column, quotes: bool = False) -> Column:
    for raw, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")) + ((('"', "&quot;"),) if quotes else ()):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _attribute(text: Column) -> Column:
    return _xml(F.regexp_replace(text, XML_INVALID, ""), quotes=True)


def junit_case() -> Column:
    """One failing test case per finding."""
    name = F.concat("path", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    message = F.substring(F.concat("severity", F.lit(": "), _said()), 1, JUNIT_MESSAGE_MAX)
    body = F.concat_ws("\n", F.when(F.col("evidence") != "", F.col("evidence")),
                       F.when(F.col("fix") != "", F.concat(F.lit("fix: "), "fix")))
    shown = _xml(F.substring(F.regexp_replace(body, XML_INVALID, ""), 1, JUNIT_BODY_MAX))
    return F.concat(F.lit('    <testcase name="'), _attribute(name), F.lit(f'" classname="{TOOL_NAME}.'),
                    _attribute(F.col("rule_id")), F.lit('"><failure message="'), _attribute(message),
                    F.lit('">'), shown, F.lit("</failure></testcase>"))


def junit(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """JUnit XML per repository: one suite per rule, a green suite for a clean repository."""
    rows = _prepared(findings)
    by_rule = score.by_rule(findings)
    totals = (repos.select("repo").distinct()
              .join(by_rule.groupBy("repo").agg(F.sum("findings").alias("n")), "repo", "left").na.fill(0, ["n"]))

    def suite_key(position: int, rest: Column | None = None) -> Column:
        rest = F.lit(None).cast("struct<neg_sev:int,path:string,line:int,scan_seq:int,rule_id:string,message:string>") if rest is None else rest
        return F.struct(F.col("rule_id").alias("suite"), F.lit(position).alias("place"), rest.alias("finding"))

    n = F.col("findings").cast("string")
    opening = by_rule.select("repo", F.lit(1).alias("section"), suite_key(0).alias("key"), F.concat(
        F.lit(f'  <testsuite name="{TOOL_NAME}.'), _attribute(F.col("rule_id")), F.lit('" tests="'), n,
        F.lit('" failures="'), n, F.lit('">')).alias("text"))
    cases = rows.select("repo", F.lit(1).alias("section"), suite_key(1, _key()).alias("key"), junit_case().alias("text"))
    closing = by_rule.select("repo", F.lit(1).alias("section"), suite_key(2).alias("key"), F.lit("  </testsuite>").alias("text"))
    total = F.col("n").cast("string")
    fixed = lambda df, section, text: df.withColumn("rule_id", F.lit(None).cast("string")).select(
        "repo", F.lit(section).alias("section"), suite_key(0).alias("key"), text.alias("text"))
    head = fixed(totals, 0, F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="{TOOL_NAME}" tests="'),
        F.greatest("n", F.lit(1)).cast("string"), F.lit('" failures="'), total, F.lit('">')))
    green = fixed(totals.where("n = 0"), 1, F.lit(f'  <testsuite name="{TOOL_NAME}" tests="1" failures="0"/>'))
    foot = fixed(totals, 2, F.lit("</testsuites>"))
    return _union([head, opening, cases, closing, green, foot])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*LINE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*LINE))
    return out


def write_documents(lines: DataFrame, path: str) -> None:
    """Write document lines under ``path/repo=…``; part files in name order form a document."""
    (lines.repartitionByRange("repo", "section", "key")
     .sortWithinPartitions("repo", "section", "key")
     .select("repo", "text").write.partitionBy("repo").mode("overwrite").text(path))
