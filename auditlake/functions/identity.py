"""Finding identity: the deduplication key and the two fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import posix, strip


def message80() -> Column:
    return F.substring("message", 1, 80)


def fingerprint() -> Column:
    """First 12 hex digits over (rule, path, line, message start)."""
    return F.substring(F.sha1(F.concat_ws(
        "|", "rule_id", "path", F.col("line").cast("string"), message80())), 1, 12)


def stable_fingerprint(evidence: Column | str = "evidence") -> Column:
    """First 12 hex digits over (rule, path, evidence start): survives line shifts."""
    column = F.col(evidence) if isinstance(evidence, str) else evidence
    return F.substring(F.sha1(F.concat_ws(
        "|", "rule_id", posix(F.col("path")), F.substring(strip(column), 1, 120))), 1, 12)


def with_identity(findings: DataFrame) -> DataFrame:
    return findings.withColumns({
        "message80": message80(),
        "fingerprint": fingerprint(),
        "stable_fingerprint": stable_fingerprint(),
    })
