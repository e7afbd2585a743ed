"""Column contracts of the tables this package reads and writes."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("tracked", T.BooleanType()),
])

SUPPRESSIONS = T.StructType([
    T.StructField("repo", T.StringType()),          # NULL = every repository
    T.StructField("rule_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("expires", T.StringType()),
])

BASELINE = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("message80", T.StringType()),
    T.StructField("stable_id", T.StringType()),
])

COMMIT_PATCHES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_seq", T.IntegerType()),   # 0 = newest
    T.StructField("commit", T.StringType()),
    T.StructField("patch", T.StringType()),
])

REMOTES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
])

CHANGED_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),          # committed/uncommitted/untracked/staged
])

TOOL_REPORTS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("tool", T.StringType()),          # pip-audit / npm
    T.StructField("target", T.StringType()),
    T.StructField("payload", T.StringType()),
])

REPORTS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# Missing text is "" and a missing line is 0, never NULL.
FINDING_COLUMNS = [
    "repo", "rule_id", "title", "sev", "severity", "message", "path", "line",
    "evidence", "fix", "cwe", "confidence", "scanner", "scan_seq",
]

KEY = ["repo", "rule_id", "path", "line", "message"]
