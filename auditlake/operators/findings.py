"""The findings table: building it, uniting scanners, deduplicating, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.identity import with_identity
from auditlake.functions.severity import severity_level
from auditlake.operators.catalog import advice
from auditlake.schemas import FINDING_COLUMNS, KEY
from auditlake.session import materialize


def as_finding(rule_id, title, severity, message, path, line, evidence, cwe, confidence, scanner,
               scan_seq: int, fix: str | None = None, fix_column: Column | None = None) -> list[Column]:
    """Select list for one finding; plain strings become literals, columns pass through."""
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    if isinstance(severity, Column):
        from auditlake.functions.severity import severity_name
        level, name = severity, severity_name(severity)
    else:
        level, name = F.lit(severity_level(severity)), F.lit(severity)
    if fix_column is None:
        fix_column = F.lit(advice(rule_id) if fix is None else fix)
    return [
        F.col("repo"), col(rule_id).alias("rule_id"), col(title).alias("title"),
        level.cast("int").alias("sev"), name.alias("severity"), col(message).alias("message"),
        col(path).alias("path"), col(line).cast("int").alias("line"),
        col(evidence).alias("evidence"), fix_column.alias("fix"), col(cwe).alias("cwe"),
        col(confidence).alias("confidence"), col(scanner).alias("scanner"),
        F.lit(scan_seq).cast("int").alias("scan_seq"),
    ]


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All scanners' findings in one table; ``scan_seq`` keeps their reporting order."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding per (repo, rule, path, line, message): most severe, then first reported.

    An aggregate rather than a window: copies of one key combine before the shuffle, so a
    key repeated across a third of the table costs one row per map task.
    """
    rest = [c for c in FINDING_COLUMNS if c not in KEY and c not in ("sev", "scan_seq")]
    best = F.min(F.struct((-F.col("sev")).alias("neg_sev"), "scan_seq", *sorted(rest)))
    return (
        findings.groupBy(*KEY).agg(best.alias("best"))
        .select(*KEY, (-F.col("best.neg_sev")).alias("sev"),
                "best.scan_seq", *[F.col(f"best.{c}") for c in rest])
        .select(*FINDING_COLUMNS)
    )


def report_order() -> list[Column]:
    return [F.col("sev").desc(), F.col("path").asc(), F.col("line").asc(),
            F.col("scan_seq").asc(), F.col("message").asc(), F.col("evidence").asc()]


def ordered(findings: DataFrame) -> DataFrame:
    """Report order within each repository."""
    return findings.orderBy("repo", *report_order())


def placed(findings: DataFrame, out: str = "place") -> DataFrame:
    """Add each finding's place in its repository's report order.

    The table is dealt to ranges of that order, of about equal size, and written once, so that a range keeps its rows. A
    place is the repository's findings in earlier ranges plus the place inside the range; a repository, path or line with a
    third of all findings is many ranges.
    """
    order = [*report_order(), F.col("rule_id").asc()]
    ranges = materialize(findings.repartitionByRange(F.col("repo").asc(), *order).withColumn("_range", F.spark_partition_id()), "placed")
    before = Window.partitionBy("repo").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("repo", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "repo", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("repo", "_range").orderBy(*order)
    return (ranges.join(counts, ["repo", "_range"])
            .withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_before", "_range"))


def gating(findings: DataFrame) -> DataFrame:
    """Findings that count for a gate: everything above INFO."""
    return findings.where(F.col("sev") > 0)


def to_report_rows(findings: DataFrame) -> DataFrame:
    """The 13-field report row of each finding, with its repository."""
    return with_identity(findings).select(
        "repo", F.col("fingerprint").alias("id"), F.col("stable_fingerprint").alias("stable_id"),
        "rule_id", "title", "severity", "message", "path", "line", "evidence", "fix", "cwe",
        "confidence", "scanner")
