"""Helpers shared by the tests."""

from auditlake.functions.severity import SEVERITIES

COLUMNS = ("repo string, rule_id string, title string, sev int, severity string, message string, path string, line int, "
           "evidence string, fix string, cwe string, confidence string, scanner string, scan_seq int")


def table(spark, rows):
    """Finding rows from (rule, sev, path, line, message, evidence) tuples, optionally with a repo."""
    full = []
    for seq, row in enumerate(rows):
        rule, sev, path, line, message, evidence, *repo = row
        full.append((repo[0] if repo else "r", rule, "T", sev, SEVERITIES[sev], message, path, line, evidence, "", "", "high", "code", seq))
    return spark.createDataFrame(full, COLUMNS)
