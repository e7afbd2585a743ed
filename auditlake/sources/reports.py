"""Report and baseline documents as finding rows, tolerant per item and strict per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.identity import stable_fingerprint
from auditlake.functions.severity import label_to, parse_severity, severity_level, severity_name

# Severity by SARIF level; the stable id is any fingerprint key with this ending.
SARIF_LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW"}
STABLE_KEY = "Stable/v1"

PARSED = ["repo", "stable_id", "rule_id", "title", "sev", "severity", "message", "path", "line",
          "evidence", "scanner", "pos"]


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    """JSON kind of a variant: OBJECT, ARRAY, STRING, BIGINT, … or VOID for null and missing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0), F.lit("VOID"))


def _is(value: Column, *kinds: str) -> Column:
    return _kind(value).isin(*kinds)


def _whole_number(value: Column) -> Column:
    """What Python's int() makes of a JSON value; NULL where it would raise."""
    text = F.trim(value.cast("string"))
    return (F.when(_is(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
                   F.try_variant_get(value, "$", "double").try_cast("int"))
            .when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast("int"))
            .when(_is(value, "STRING") & text.rlike(r"\A[+-]?\d+\z"), text.try_cast("int")))


def _text_or(value: Column, missing: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def load_reports(reports: DataFrame, strict: bool = True) -> DataFrame:
    """Findings of SARIF 2.1.0 and JSON reports (``repo``, ``payload``), with ``pos`` as ordinal.

    A document that is no report, or whose findings are all unusable, must not look like a clean one: it raises, or, with
    ``strict=False``, gives no rows here and one in :func:`report_errors`, so that it stops no other repository.
    """
    parsed = report_shape(reports, strict)
    sarif = (parsed.where("shape = 'sarif'").select("repo", F.posexplode("runs").alias("run_no", "run"))
             .where(_is(F.col("run"), "OBJECT"))
             .select("repo", "run_no", F.posexplode(_get(F.col("run"), "$.results", "array<variant>")).alias("item_no", "item")))
    plain = (parsed.where("shape = 'findings'")
             .select("repo", F.lit(0).alias("run_no"), F.posexplode("items").alias("item_no", "item")))
    return (_sarif_rows(sarif).unionByName(_json_rows(plain))
            .withColumn("pos", F.col("run_no").cast("long") * F.lit(1 << 32) + F.col("item_no"))
            .select(*PARSED))


def report_errors(reports: DataFrame) -> DataFrame:
    """(repo, error) of each document :func:`load_reports` cannot use."""
    return report_shape(reports, strict=False).where("error is not null").select("repo", "error")


def report_shape(reports: DataFrame, strict: bool = True) -> DataFrame:
    """Parse and classify each document; an unusable one raises if ``strict``, else it has shape ``none`` and an ``error``."""
    doc = F.col("doc")
    shaped = (
        reports.select("repo", "payload", F.try_parse_json("payload").alias("doc"))
        .withColumn("runs", F.coalesce(_get(doc, "$.runs", "array<variant>"), F.array().cast("array<variant>")))
        .withColumn("items", F.coalesce(_get(doc, "$.findings", "array<variant>"), F.array().cast("array<variant>")))
        .withColumn("shape", F.when(~_is(doc, "OBJECT"), "none")
                    .when(_has(doc, "runs"), "sarif").when(_has(doc, "findings"), "findings").otherwise("none"))
    )
    counted = shaped.withColumn("raw", F.when(F.col("shape") == "sarif", F.aggregate(
        "runs", F.lit(0), lambda n, run: n + F.coalesce(F.size(_get(run, "$.results", "array<variant>")), F.lit(0))))
        .otherwise(F.size("items")))
    usable = F.when(F.col("shape") == "sarif", F.exists("runs", lambda run: F.coalesce(F.exists(
        _get(run, "$.results", "array<variant>"), _sarif_usable), F.lit(False)))
    ).otherwise(F.exists("items", _json_usable))
    error = (F.when(F.col("shape") == "none", F.lit("not a findings or SARIF report"))
             .when((F.col("raw") > 0) & ~F.coalesce(usable, F.lit(False)), F.concat(F.col("raw").cast("string"), F.lit(" findings but none parseable"))))
    judged = counted.withColumn("error", error)
    bad = F.col("error").isNotNull()
    # The check sits in the column the rows come from, so it cannot be pruned away.
    verdict = F.when(bad, F.raise_error(F.concat("error", F.lit(": "), "repo")) if strict else F.lit("none")).otherwise(F.col("shape"))
    return judged.withColumn("shape", verdict.cast("string")).drop("payload", "raw")


def _has(doc: Column, key: str) -> Column:
    keys = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def _first_location(item: Column) -> Column:
    return F.get(_get(item, "$.locations", "array<variant>"), F.lit(0))


def _optional_object(value: Column) -> Column:
    """A part that may be missing, null, empty or an object; any other value spoils the item."""
    return _is(value, "VOID", "OBJECT") | (value.cast("string").isin("", "0", "false"))


def _sarif_usable(item: Column) -> Column:
    locations = _get(item, "$.locations", "variant")
    first = _first_location(item)
    physical = _get(first, "$.physicalLocation", "variant")
    start = _get(physical, "$.region.startLine", "variant")
    return (
        _is(item, "OBJECT") & _has(item, "ruleId")
        & (_is(locations, "VOID", "ARRAY") | F.coalesce(locations.cast("string").isin("", "0", "false"), F.lit(False)))
        & (first.isNull() | _is(first, "OBJECT"))
        & _optional_object(physical)
        & _optional_object(_get(physical, "$.artifactLocation", "variant"))
        & _optional_object(_get(physical, "$.region", "variant"))
        & (_is(start, "VOID") | (start.cast("string") == "") | _whole_number(start).isNotNull())
    )


def _sarif_rows(items: DataFrame) -> DataFrame:
    item = F.col("item")
    physical = _get(_first_location(item), "$.physicalLocation", "variant")
    rule = _get(item, "$.ruleId")
    message = _get(item, "$.message", "variant")
    level = F.lower(F.coalesce(_get(item, "$.level"), F.lit("warning")))
    fallback = label_to(level, {k: severity_level(v) for k, v in SARIF_LEVELS.items()},
                        F.lit(severity_level("MEDIUM")))
    prints = F.map_entries(_get(item, "$.partialFingerprints", "map<string,variant>"))
    given = F.get(F.filter(prints, lambda e: e["key"].endswith(STABLE_KEY)), F.lit(0))["value"].cast("string")
    rows = items.where(_sarif_usable(item)).select(
        "repo", "run_no", "item_no", _text_or(rule, "None").alias("rule_id"),
        F.coalesce(_get(item, "$.properties.title"), rule).alias("title"),
        F.coalesce(parse_severity(_get(item, "$.properties.severity")), fallback).alias("sev"),
        F.coalesce(F.when(_is(message, "OBJECT"), _get(message, "$.text")).when(
            ~_is(message, "ARRAY"), message.cast("string")), F.lit("")).alias("message"),
        F.coalesce(_get(physical, "$.artifactLocation.uri"), F.lit("")).alias("path"),
        F.coalesce(_whole_number(_get(physical, "$.region.startLine", "variant")), F.lit(0)).alias("line"),
        F.lit("").alias("evidence"), F.lit("sarif").alias("scanner"), given.alias("given"))
    return _with_stable_id(rows)


def _json_usable(item: Column) -> Column:
    line = _get(item, "$.line", "variant")
    return (_is(item, "OBJECT") & _has(item, "rule_id")
            & (_is(line, "VOID") | (line.cast("string") == "") | _whole_number(line).isNotNull()))


def _json_rows(items: DataFrame) -> DataFrame:
    item = F.col("item")

    def text(key):
        return F.coalesce(_get(item, f"$.{key}"), F.when(_has(item, key), "None").otherwise(""))

    rows = items.where(_json_usable(item)).select(
        "repo", "run_no", "item_no", text("rule_id").alias("rule_id"), text("title").alias("title"),
        F.coalesce(parse_severity(_get(item, "$.severity")), F.lit(severity_level("MEDIUM"))).alias("sev"),
        text("message").alias("message"), text("path").alias("path"),
        F.coalesce(_whole_number(_get(item, "$.line", "variant")), F.lit(0)).alias("line"),
        text("evidence").alias("evidence"), F.lit("json").alias("scanner"),
        _get(item, "$.stable_id").alias("given"))
    return _with_stable_id(rows)


def _with_stable_id(rows: DataFrame) -> DataFrame:
    own = stable_fingerprint()
    given = F.col("given")
    return (rows.withColumn("stable_id", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(own))
            .withColumn("severity", severity_name(F.col("sev"))).drop("given"))


def load_baselines(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline documents (``repo``, ``payload``) to entries, and an error row per unusable one.

    A document may be an object with ``findings`` or a bare list. Bad entries are dropped;
    a document that yields none of its entries is reported and not applied.
    """
    doc = F.col("doc")
    parsed = documents.select("repo", F.try_parse_json("payload").alias("doc"))
    items = (F.when(_is(doc, "OBJECT") & ~_has(doc, "findings"), F.array().cast("array<variant>"))
             .when(_is(doc, "OBJECT"), F.when(_is(_get(doc, "$.findings", "variant"), "ARRAY"),
                                              _get(doc, "$.findings", "array<variant>")))
             .when(_is(doc, "ARRAY"), _get(doc, "$", "array<variant>")))

    def good(item):
        line = _get(item, "$.line", "variant")
        return (_is(item, "OBJECT") & _has(item, "rule_id") & _has(item, "path")
                & (~_has(item, "line") | _whole_number(line).isNotNull()))

    shaped = parsed.withColumn("items", items).withColumn("good", F.filter("items", good))
    entries = shaped.select("repo", F.explode("good").alias("e")).select(
        "repo", _get(F.col("e"), "$.rule_id").alias("rule_id"), _get(F.col("e"), "$.path").alias("path"),
        F.coalesce(_whole_number(_get(F.col("e"), "$.line", "variant")), F.lit(0)).alias("line"),
        F.substring(F.coalesce(_get(F.col("e"), "$.message"), F.when(_has(F.col("e"), "message"), "None")
                               .otherwise("")), 1, 80).alias("message80"),
        F.coalesce(_get(F.col("e"), "$.stable_id"), F.lit("")).alias("stable_id")).distinct()
    errors = shaped.select("repo", F.when(F.col("items").isNull(), "unreadable").when(
        (F.size("items") > 0) & (F.size("good") == 0), "no usable entries").alias("error")).where("error is not null")
    return entries, errors
