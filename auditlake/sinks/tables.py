"""Findings, baselines and diffs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.findings import to_report_rows
from auditlake.operators.suppress import baseline_of


def _by_repo(df: DataFrame) -> DataFrame:
    """Few files per repository: small repositories share a task, large ones are split."""
    return df.hint("rebalance", "repo")


def write_findings(findings: DataFrame, path: str) -> None:
    """The 13-field finding rows, partitioned by repository for partition pruning."""
    _by_repo(to_report_rows(findings)).write.mode("overwrite").partitionBy("repo").parquet(path)


def write_baseline(findings: DataFrame, path: str, scanned: DataFrame | None = None) -> None:
    """Replace the baseline of the ``scanned`` repositories (default: those in ``findings``); others stay as they are.

    A scanned repository without findings is replaced, too: a row with an empty rule_id, which no finding matches, takes the
    place of its old entries. ``findings`` must not have been filtered by the old baseline, or its entries would go.
    """
    entries = baseline_of(findings)
    if scanned is not None:
        clean = scanned.select("repo").distinct().join(findings.select("repo").distinct(), "repo", "left_anti")
        entries = entries.unionByName(clean.select("repo", *[F.lit("").alias(c) for c in ("rule_id", "path")], F.lit(0).alias("line"),
                                                   *[F.lit("").alias(c) for c in ("message80", "stable_id")]))
    stamped = entries.withColumn("generated", F.date_format(F.now(), "yyyy-MM-dd'T'HH:mm:ss"))
    (_by_repo(stamped).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path))


def write_diff(diff, path: str) -> None:
    """Added and removed rows under ``path/rows`` by status, totals under ``path/counts``."""
    diff.rows.write.mode("overwrite").partitionBy("status").parquet(f"{path}/rows")
    diff.counts.write.mode("overwrite").parquet(f"{path}/counts")
