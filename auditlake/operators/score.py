"""Score, grade, counts and gates: one partial aggregate per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.severity import SEVERITIES, severity_level, severity_weight
from auditlake.options import GATE_OFF

# Lowest score of each grade.
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 50))


def grade_of(score: Column, worst: Column) -> Column:
    """Letter for a score; a critical finding turns an A or B into a D."""
    grade = F.lit("F")
    for letter, floor in reversed(GRADES):
        grade = F.when(score >= floor, letter).otherwise(grade)
    critical = worst == severity_level("CRITICAL")
    return F.when(critical & grade.isin("A", "B"), "D").otherwise(grade)


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("sev") == i).alias(name) for i, name in enumerate(SEVERITIES)]


def posture(findings: DataFrame, repos: DataFrame | None = None, by=("repo",)) -> DataFrame:
    """Score, grade and severity counts per group; groups of ``repos`` without findings score 100."""
    by = list(by)
    grouped = findings.groupBy(*by).agg(
        F.sum(severity_weight(F.col("sev"))).alias("deductions"), F.max("sev").alias("worst"),
        F.count(F.lit(1)).alias("findings"), *severity_counts())
    if repos is not None:
        zero = {c: 0 for c in ("deductions", "findings", *SEVERITIES)}
        grouped = repos.select(*by).distinct().join(grouped, by, "left").na.fill(zero)
    return graded(grouped, by)


def graded(grouped: DataFrame, by: list[str]) -> DataFrame:
    """Score and grade of groups with deductions, worst severity and severity counts."""
    score = F.greatest(F.lit(0), 100 - F.col("deductions")).cast("int")
    return (grouped.withColumn("score", score)
            .withColumn("grade", grade_of(F.col("score"), F.coalesce("worst", F.lit(-1))))
            .select(*by, "score", "grade", "findings", *reversed(SEVERITIES)))


def posture_rollup(findings: DataFrame, levels: list[str], repos: DataFrame | None = None) -> DataFrame:
    """Posture of every prefix of ``levels``, from the whole down to the last, in one pass.

    ``levels`` are columns from coarse to fine, such as team, repo and directory. Sums and the worst severity merge upwards, so
    findings are aggregated once at the finest level, on the map side first, and only those groups are rolled up. Columns below
    a row's level are null, and ``depth`` (0 for the whole) tells them from levels that are null themselves. ``repos`` adds
    groups without findings: its rows hold the levels it knows, a prefix of ``levels``; the groups above them are added with them.
    """
    totals = ["deductions", "findings", *SEVERITIES]
    finest = findings.groupBy(*levels).agg(
        F.sum(severity_weight(F.col("sev"))).alias("deductions"), F.max("sev").alias("worst"),
        F.count(F.lit(1)).alias("findings"), *severity_counts()).withColumn("known", F.lit(len(levels)))
    if repos is not None:
        known = [c for c in levels if c in repos.columns]
        if known != levels[:len(known)]:
            raise ValueError(f"repos must hold a prefix of {levels}")
        finest = finest.unionByName(repos.select(*known).distinct().withColumn("known", F.lit(len(known))), allowMissingColumns=True)
    rolled = finest.rollup(*levels).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals], F.max("worst").alias("worst"), F.max("known").alias("known"),
        F.grouping_id(*levels).alias("_id"))
    depth = F.lit(len(levels)) - F.bit_count("_id")
    # a group without findings has no rows below the levels it is known by
    return graded(rolled.withColumn("depth", depth.cast("int")).where("depth <= known"), ["depth", *levels])


def gate(findings: DataFrame, fail_on: str, repos: DataFrame | None = None) -> DataFrame:
    """Per repository: does any finding above INFO reach ``fail_on``? Off words never fail."""
    if fail_on.lower() in GATE_OFF:
        reached = F.lit(False)
    else:
        threshold = severity_level(fail_on)
        if threshold is None:
            raise ValueError(f"unknown severity: {fail_on!r}")
        reached = F.bool_or((F.col("sev") >= threshold) & (F.col("sev") > 0))
    out = findings.groupBy("repo").agg(reached.alias("failed"))
    if repos is not None:
        out = (repos.select("repo").distinct().join(out, "repo", "left")
               .withColumn("failed", F.coalesce("failed", F.lit(False))))
    return out


def gate_by_level(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """``gate`` with a least severity per repository: ``levels`` has repo and gate, null where nothing fails."""
    worst = findings.where(F.col("sev") > 0).groupBy("repo").agg(F.max("sev").alias("worst"))
    return levels.join(worst, "repo", "left").select("repo", F.coalesce(F.col("worst") >= F.col("gate"), F.lit(False)).alias("failed"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "rule_id").agg(F.count(F.lit(1)).alias("findings"))


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("findings"), F.max("sev").alias("worst"))
