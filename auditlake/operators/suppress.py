"""Configured suppressions and baselines: equi joins on exact keys.

A suppression concerns (repo, rule, path) only, so it is matched against the distinct triples of the findings table, by
equality on the repository it names. A suppression for every repository is matched once against the distinct (rule, path)
pairs of all repositories, whatever their number, and the pairs it covers select the triples. Suppressions without a path
join on the rule. Exact paths and directories join on every parent of the path. Shell patterns join on their literal leading
directory as well and only then compare text. All of these are keys of one join, whose rows are bounded by the matches of a
triple or pair. No side is force-broadcast and nothing is salted: joins that one key makes large are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.globs import shell_regex_column
from auditlake.functions.identity import message80, stable_fingerprint
from auditlake.functions.text import posix
from auditlake.schemas import SUPPRESSIONS

TARGET = ["repo", "rule_id", "path"]


def suppression_table(spark: SparkSession, entries) -> DataFrame:
    rows = [(s.repo, s.rule_id, s.path, s.reason, s.expires) for s in entries]
    return spark.createDataFrame(rows, SUPPRESSIONS)


def active(suppressions: DataFrame, today: Column | None = None) -> DataFrame:
    """Undated suppressions and those whose ISO date has not passed; malformed dates never apply."""
    today = F.current_date() if today is None else today
    expires = F.coalesce(F.col("expires"), F.lit(""))
    on = (F.when(expires.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(expires, "yyyy-MM-dd"))
          .when(expires.rlike(r"\A\d{8}\z"), F.try_to_date(expires, "yyyyMMdd")))
    return suppressions.where((expires == "") | F.coalesce(on >= today, F.lit(False)))


def _parents(path: Column) -> Column:
    """The directories above a path, from "" for the root downwards."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array(F.lit("")))


def _literal_directory(pattern: Column) -> Column:
    """The directories in front of a pattern's first special character: every path it matches lies below them."""
    return F.regexp_extract(pattern, r"\A((?:[^*?\[/]*/)*)[^/]*?[*?\[]", 1)


def matched_targets(findings: DataFrame, suppressions: DataFrame,
                    today: Column | None = None) -> DataFrame:
    """The distinct (repo, rule, path) triples that an active suppression covers."""
    rules = active(suppressions, today).select(
        F.col("repo").alias("s_repo"), F.coalesce("rule_id", F.lit("*")).alias("rule_key"),
        posix(F.coalesce("path", F.lit(""))).alias("s_path")).distinct()
    targets = findings.select(*TARGET).distinct()
    own = _covered(targets, rules.where("s_repo is not null").withColumnRenamed("s_repo", "repo"), ["repo"])
    shared = _covered(targets.select("rule_id", "path").distinct(), rules.where("s_repo is null"), [])
    return own.unionByName(targets.join(shared, ["rule_id", "path"], "left_semi")).distinct()


def _covered(targets: DataFrame, rules: DataFrame, scope: list[str]) -> DataFrame:
    """The targets that a rule of their ``scope`` covers, by equality on the scope, the rule and a piece of the path."""
    # One key per piece, so that one join does for all kinds of rules. An exact path and a directory may look alike, so each key
    # says what it is: any path, an exact path, a directory, or the directory that a pattern lies under.
    def key(kind, piece, rx=F.lit(None).cast("string")):
        return F.struct(F.concat(F.lit(kind), piece).alias("key"), rx.alias("rx"))

    rule = F.col("s_path")
    literal = F.array(key("f:", rule), key("d:", F.rtrim(rule, F.lit("/"))))
    pattern = F.array(key("p:", F.rtrim(_literal_directory(rule), F.lit("/")), F.col("translated")))
    keyed_rules = (rules.withColumn("translated", shell_regex_column("s_path")).select(*scope, "rule_key", F.inline(
        F.when(rule == "", F.array(key("a:", F.lit("")))).when(rule.rlike(r"[*?\[]"), F.concat(literal, pattern)).otherwise(literal))).distinct())

    slashed = posix(F.col("path"))
    pieces = F.concat(F.array(F.lit("a:"), F.concat(F.lit("f:"), slashed)), F.flatten(F.transform(
        _parents(slashed), lambda p: F.array(F.concat(F.lit("d:"), p), F.concat(F.lit("p:"), p)))))
    keyed = (targets.withColumn("rule_key", F.explode(F.array_distinct(F.array(F.lit("*"), "rule_id")))).withColumn("key", F.explode(pieces)))
    return (keyed.join(keyed_rules, [*scope, "rule_key", "key"])
            .where(~F.col("key").startswith("p:") | F.expr("replace(path, '\\\\', '/') rlike rx"))
            .select(*targets.columns).distinct())


def split_suppressed(findings: DataFrame, suppressions: DataFrame,
                     today: Column | None = None) -> DataFrame:
    """Findings with a ``suppressed`` flag (one left join, so both halves come from one pass)."""
    covered = matched_targets(findings, suppressions, today).withColumn("suppressed", F.lit(True))
    return findings.join(covered, TARGET, "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def apply_suppressions(findings: DataFrame, suppressions: DataFrame,
                       today: Column | None = None) -> DataFrame:
    return findings.join(matched_targets(findings, suppressions, today), TARGET, "left_anti")


def baseline_of(findings: DataFrame) -> DataFrame:
    """Baseline entries for the given findings."""
    return findings.select("repo", "rule_id", "path", "line", message80().alias("message80"),
                           stable_fingerprint().alias("stable_id"))


def subtract_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop findings known by exact key or, for entries that carry one, by stable id."""
    exact = baseline.select("repo", "rule_id", "path", "line", "message80").distinct()
    stable = (baseline.where(F.coalesce("stable_id", F.lit("")) != "")
              .select("repo", F.col("stable_id").alias("stable_fingerprint")).distinct())
    return (findings
            .withColumns({"message80": message80(), "stable_fingerprint": stable_fingerprint()})
            .join(exact, ["repo", "rule_id", "path", "line", "message80"], "left_anti")
            .join(stable, ["repo", "stable_fingerprint"], "left_anti")
            .drop("message80", "stable_fingerprint"))


def accept_findings(findings: DataFrame, suppressions: DataFrame, wanted: DataFrame,
                    reason: str = "", today: Column | None = None) -> DataFrame:
    """Resolve fingerprint prefixes (``wanted``: repo, prefix) and give the suppressions to append.

    One row per wanted prefix: repo, prefix, ``status`` and the suppression's rule_id, path, reason and expires. The status
    is accepted, covered (a suppression holds already), unknown, ambiguous or short (under 6 characters); only accepted rows
    carry a suppression. ``findings`` is the table before suppressions. All repositories are resolved in one join.
    """
    from auditlake.functions.identity import fingerprint

    asked = wanted.select("repo", F.lower(F.trim("prefix")).alias("prefix")).distinct().withColumn("head", F.substring("prefix", 1, 6))
    printed = findings.select("repo", "rule_id", "path", fingerprint().alias("fingerprint")).withColumn("head", F.substring("fingerprint", 1, 6))
    hits = (printed.join(asked, ["repo", "head"]).where(F.col("fingerprint").startswith(F.col("prefix")))
            .groupBy("repo", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rule_id", "path", "fingerprint")).alias("f")))
    found = asked.join(hits, ["repo", "prefix"], "left").select("repo", "prefix", "n", "f.*")
    covered = matched_targets(found.where("n = 1"), suppressions, today).withColumn("covered", F.lit(True))
    status = (F.when(F.length("prefix") < 6, "short").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous")
              .when(F.coalesce("covered", F.lit(False)), "covered").otherwise("accepted"))
    accepted = F.col("status") == "accepted"
    text = F.lit(reason) if reason else F.concat(F.lit("accepted finding ("), "fingerprint", F.lit(")"))
    return found.join(covered, TARGET, "left").withColumn("status", status).select(
        "repo", "prefix", "status", F.when(accepted, F.col("rule_id")).alias("rule_id"), F.when(accepted, posix(F.col("path"))).alias("path"),
        F.when(accepted, text).alias("reason"), F.when(accepted, F.lit("")).alias("expires"))


def accept_finding(findings: DataFrame, suppressions: DataFrame, prefix: str,
                   reason: str = "", today: Column | None = None) -> DataFrame:
    """The suppression for the one finding whose fingerprint starts with ``prefix``, in whatever repository.

    Empty when the finding is already covered; a prefix that is too short, unknown or ambiguous raises. ``findings`` is the
    table before suppressions.
    """
    wanted = findings.select("repo").distinct().withColumn("prefix", F.lit(prefix))
    rows = accept_findings(findings, suppressions, wanted, reason, today)
    counts = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}   # at most five rows
    if counts.get("short"):
        raise ValueError("a fingerprint prefix needs at least 6 characters")
    matched = counts.get("accepted", 0) + counts.get("covered", 0)
    if counts.get("ambiguous") or matched > 1:
        raise ValueError(f"fingerprint {prefix!r} is ambiguous")
    if not matched:
        raise ValueError(f"no finding matches fingerprint {prefix!r}")
    return rows.where("status = 'accepted'").select("repo", "rule_id", "path", "reason", "expires")
