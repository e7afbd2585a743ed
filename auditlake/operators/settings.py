"""Settings per repository: read once per different text, applied as columns of the rows they concern.

Every repository may bring its own excludes, limits, allow lists, custom rules, suppressions and gate. Repositories map to a setting,
a setting to its values; both maps are measured and broadcast where small, so the file table is neither shuffled nor joined on
pattern text. The exclude patterns and custom rules that most settings share are literal expressions, chosen by a number; the
rest, however many, are columns of the setting's row. Both ways give the same findings.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.globs import exclude_pattern
from auditlake.functions.severity import severity_level
from auditlake.functions.text import UNICODE, posix, sql_list, sql_text
from auditlake.options import GATE_OFF, ScanOptions
from auditlake.schemas import SUPPRESSIONS
from auditlake.session import materialize

#: Different exclude expressions, and different custom rules, that become literal expressions of the plan.
LITERALS = 64
#: A map measured to be at most this large may be broadcast.
SMALL_BYTES = 32_000_000
#: Name of the column that holds a row's settings.
ROW = "_settings"
DEFAULT = "default"

RULE = "struct<key:string,id:string,title:string,severity:string,pattern:string,message:string,fix:string,extensions:array<string>,cwe:string,confidence:string>"
PARSED = ("setting string, exclude string, max_file_bytes long, allow array<string>, word string, marker string, inline boolean, history boolean, "
          f"history_commits int, history_bytes long, deps_cves boolean, gate int, rules array<{RULE}>, "
          "suppressions array<struct<repo:string,rule_id:string,path:string,reason:string,expires:string>>, notes array<string>")
OWN = ["exclude", "exclude_no", "max_file_bytes", "allow", "word", "marker", "inline", "history", "history_commits", "history_bytes", "deps_cves",
       "gate", "rule_keys", "own_rules"]


def _python_problem(pattern: str) -> str | None:
    """A first look at a custom rule's pattern; what the engine alone rejects is found later, for all patterns together."""
    return None if pattern else "is empty"


def parse_setting(setting: str, text: str | None) -> dict:
    """The values of one settings text (JSON); what cannot be used becomes a note and the default holds."""
    from auditlake.operators.inline_ignore import marker_pattern

    notes = []
    try:
        data = json.loads(text) if text else {}
        if not isinstance(data, dict):
            data, notes = {}, ["settings are not a table; defaults hold"]
    except ValueError:
        data, notes = {}, ["settings are not valid JSON; defaults hold"]
    entries = data.pop("custom_rules", None) or []
    options = ScanOptions.from_mapping(data)
    from auditlake.options import validate_custom_rules
    options.custom_rules, more = validate_custom_rules(entries if isinstance(entries, list) else [], _python_problem)
    rules = []
    for rule in options.custom_rules:
        row = asdict(rule) | {"extensions": None if rule.extensions is None else list(rule.extensions)}
        rules.append({"key": hashlib.sha1(json.dumps(row, sort_keys=True).encode()).hexdigest()} | row)
    return {
        "setting": setting, "exclude": exclude_pattern(options.excludes), "max_file_bytes": options.max_file_bytes,
        "allow": sorted({a.lower() for a in options.allow_secrets if a}), "word": options.ignore_marker.lower(), "marker": marker_pattern(options.ignore_marker),
        "inline": options.inline_suppressions, "history": options.history, "history_commits": options.history_commits,
        "history_bytes": options.history_bytes, "deps_cves": options.deps_cves,
        "gate": None if options.fail_on.lower() in GATE_OFF else severity_level(options.fail_on), "rules": rules,
        "suppressions": [asdict(s) for s in options.suppressions], "notes": notes + options.notes + more}


def rejected_patterns(patterns: DataFrame, block: int = 256) -> list[str]:
    """Those of ``patterns`` (pattern) that the engine cannot compile. A block of them at a time comes to the driver, where the
    engine folds a literal match with each; a block that holds a bad one is halved until it stands alone."""
    one, bad, waiting = patterns.sparkSession.sql("SELECT 1 AS one"), [], []

    def look(some: list[str]) -> None:
        try:
            one.select(*[F.lit("").rlike(UNICODE + p).alias(f"p{i}") for i, p in enumerate(some)]).collect()
        except PySparkException:
            if len(some) == 1:
                bad.append(some[0])
            else:
                look(some[:len(some) // 2])
                look(some[len(some) // 2:])

    for row in patterns.distinct().toLocalIterator():
        waiting.append(row.pattern)
        if len(waiting) == block:
            look(waiting)
            waiting = []
    if waiting:
        look(waiting)
    return bad


def _bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def _maybe_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _bytes(df) <= SMALL_BYTES else df


class RepoSettings:
    """What ``scan`` and its operators take instead of one ScanOptions for all repositories.

    ``table`` has a row per repository: repo, settings (a JSON table of the keys ``ScanOptions.from_mapping`` knows). Of several
    rows of a repository the least text counts, with a note. Null or empty settings, and repositories without a row, have the
    defaults. Settings that cannot be read leave a note for their repository and never stop the scan.
    """

    def __init__(self, table: DataFrame, literals: int = LITERALS):
        spark = self.spark = table.sparkSession
        given = table.where("repo is not null").groupBy("repo").agg(F.min("settings").alias("settings"), F.count_distinct("settings").alias("n"))
        by_repo = materialize(given.select("repo", "settings", "n", F.coalesce(F.sha1("settings"), F.lit(DEFAULT)).alias("setting")), "repo-settings")
        texts = by_repo.select("setting", "settings").unionByName(
            spark.createDataFrame([(DEFAULT, None)], "setting string, settings string")).distinct()

        def parse(frames):
            for frame in frames:
                yield pd.DataFrame([parse_setting(s, t) for s, t in zip(frame["setting"], frame["settings"])], columns=_names(PARSED)).astype(
                    {"max_file_bytes": "Int64", "history_commits": "Int32", "history_bytes": "Int64", "gate": "Int32"})

        parsed = materialize(texts.repartition("setting").mapInPandas(parse, PARSED), "settings")
        bad = rejected_patterns(parsed.select(F.explode("rules.pattern").alias("pattern")))
        fits = F.filter("rules", lambda r: ~r["pattern"].isin(bad)) if bad else F.col("rules")
        refused = F.transform(F.filter("rules", lambda r: r["pattern"].isin(bad)), lambda r: F.concat(
            F.lit("custom rule "), r["id"], F.lit(" left out: it has a pattern the engine rejects"))) if bad else F.array().cast("array<string>")
        parsed = parsed.withColumns({"notes": F.concat("notes", refused), "rules": fits})
        used = by_repo.groupBy("setting").agg(F.count("*").alias("repos"))
        weighed = parsed.join(used, "setting", "left").withColumn("repos", F.coalesce("repos", F.lit(1)))
        # the most shared ones become literals: at most ``literals`` of either are collected
        self.excludes = [r.exclude for r in weighed.where("exclude is not null").groupBy("exclude").agg(F.sum("repos").alias("n")).orderBy(
            F.desc("n"), "exclude").limit(literals).collect()]
        each = weighed.select("repos", F.explode("rules").alias("r"))
        self.shared_rules = [r.r for r in each.groupBy("r.key").agg(F.sum("repos").alias("n"), F.first("r").alias("r")).orderBy(
            F.desc("n"), "key").limit(literals).collect()]
        keys = [r.key for r in self.shared_rules]
        number = F.create_map(*[F.lit(x) for pair in ((e, i) for i, e in enumerate(self.excludes)) for x in pair])[F.col("exclude")] if self.excludes else F.lit(None)
        values = parsed.withColumns({
            "exclude_no": number.cast("int"), "rule_keys": F.col("rules.key"),
            "own_rules": F.filter("rules", lambda r: ~r["key"].isin(keys)) if keys else F.col("rules")})
        self.values = materialize(values.select("setting", F.struct(*OWN).alias(ROW)), "setting-values")
        self.by_repo = _maybe_small(by_repo.select("repo", "setting"))
        self.rules = materialize(each.select("r.*").dropDuplicates(["key"]), "custom-rules")
        self.suppressions = by_repo.join(parsed, "setting").select(F.col("repo").alias("of"), F.inline("suppressions")).select(
            F.col("of").alias("repo"), *[f.name for f in SUPPRESSIONS.fields[1:]])
        twice = by_repo.where("n > 1").select("repo", F.lit("several settings: the least text counts").alias("note"))
        self.notes = by_repo.join(parsed, "setting").select("repo", F.explode("notes").alias("note")).unionByName(twice)
        self._small_values = _maybe_small(self.values)

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their repository's settings in one struct column; rows that have it are left as they are."""
        if ROW in rows.columns:
            return rows
        known = rows.join(self.by_repo, "repo", "left").withColumn("setting", F.coalesce("setting", F.lit(DEFAULT)))
        return known.join(self._small_values, "setting").drop("setting")

    def is_excluded(self, path: Column) -> Column:
        """Whether a row's own patterns exclude ``path``; shared expressions are literals, the others the row's column."""
        plain, chosen = posix(path), None
        for i, pattern in enumerate(self.excludes):
            branch = plain.rlike(pattern)
            chosen = F.when(F.col(f"{ROW}.exclude_no") == i, branch) if chosen is None else chosen.when(F.col(f"{ROW}.exclude_no") == i, branch)
        own = F.call_function("rlike", plain, F.col(f"{ROW}.exclude"))
        return F.coalesce(own if chosen is None else chosen.otherwise(own), F.lit(False))

    def too_big(self) -> Column:
        return F.coalesce(F.col("size_bytes") > F.col(f"{ROW}.max_file_bytes"), F.lit(False))

    def custom_hits(self, hit, none: str) -> list[Column]:
        """Hit arrays of the custom rules that a row's settings name, in no particular order."""
        parts = []
        for rule in self.shared_rules:
            gate = f"array_contains({ROW}.rule_keys, {sql_text(rule.key)})"
            if rule.extensions is not None:
                gate += f" and ext in {sql_list(rule.extensions)}"
            fires = f"l.text rlike {sql_text(UNICODE + rule.pattern)}"
            parts.append(F.expr(f"if({gate}, transform(filter(physical, l -> {fires}), l -> "
                                f"{hit(rule.id, 'l.line', 'l.text', 'custom:' + rule.key)}), {none})"))
        own = ("named_struct('rule_id', r.id, 'line', l.line, 'shown', l.text, 'message', '', 'scanner', concat('custom:', r.key))")
        parts.append(F.expr(
            f"flatten(transform(filter({ROW}.own_rules, r -> r.extensions is null or array_contains(r.extensions, ext)), r -> "
            f"transform(filter(physical, l -> l.text rlike concat({sql_text(UNICODE)}, r.pattern)), l -> {own})))"))
        return parts

    def all_rules(self, builtin: DataFrame, first_seq: int) -> DataFrame:
        """The described built-in rules and all custom ones, keyed as their hits are."""
        level = F.expr("case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end")
        custom = self.rules.select(F.concat(F.lit("custom:"), "key").alias("rule_key"), "title", level.cast("int").alias("sev"), "severity", "cwe",
                                   "confidence", "fix", F.lit(first_seq).alias("scan_seq"), F.col("message").alias("fixed_message"))
        return _maybe_small(builtin.unionByName(custom))

    def gate_levels(self, repos: DataFrame) -> DataFrame:
        """(repo, gate): the least severity that fails a repository, null where its gate is off."""
        return self.attach(repos.select("repo").distinct()).select("repo", F.col(f"{ROW}.gate").alias("gate"))


def _names(schema: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) (?=[a-z])", schema)
