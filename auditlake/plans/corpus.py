"""Inputs of the registered queries, derived from the given tables as a whole.

Documents become files (``source`` is the repository; the appended sample decides name
and language), conversations become commit patches, events become finding tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.severity import severity_name
from auditlake.plans.samples import API_KEY, AWS_KEY, SAMPLES

DIRECTORIES = ("src", "lib/core", "node_modules/pkg", "app/vendor/x", "build", "tests/fixtures",
               "pkg.egg-info", "docs", "dist/js", "web/coverage")


PATCH_LINES = (f'+key = "{AWS_KEY}"', '-password = "hunter2' + 'secret99"', " context", f"+t = '{API_KEY}'", "+plain = 1")
PATCH_PATHS = ("src/app.py", "vendor/lib.py", "conf/.env", "docs/a.md")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """The entry of a literal list at ``index`` modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source's repository."""
    doc_id = F.col("doc_id")
    text = F.concat("text", F.lit("\n"), pick([t for _, t in SAMPLES], doc_id), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/d"), doc_id.cast("string"), F.lit("/"), pick([n for n, _ in SAMPLES], doc_id)).alias("path"),
        F.octet_length(text).cast("long").alias("size_bytes"), text.alias("text"),
        (doc_id % 3 != 0).alias("tracked"))


def placed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a path-only file spread over excluded and ordinary places."""
    doc_id = F.col("doc_id")
    names = sorted({n for n, _ in SAMPLES}) + ["bundle.min.js", "yarn.lock", "photo.png", "Makefile", "id_rsa",
                                               ".env.local", "server.pem", "store.p12", "credentials", ".envrc",
                                               "dockerfile.prod", "README", "x.map"]
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat(pick(DIRECTORIES, doc_id), F.lit("/d"), doc_id.cast("string"), F.lit("/"),
                 pick(names, F.floor(doc_id / 3))).alias("path"),
        (F.col("n_chars") * 400).alias("size_bytes"), F.col("text"), (doc_id % 4 != 0).alias("tracked"))


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a finding: user group = repository, type = rule, props = path, hour = line."""
    kind = F.col("event_type")
    level = (F.when(kind == "error", 4).when(kind == "purchase", 3).when(kind == "signup", 2)
             .when(kind == "click", 1).otherwise(0))
    key = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("repo"),
        F.concat(F.lit("EV"), F.upper(kind)).alias("rule_id"), F.concat(F.lit("Event "), kind).alias("title"),
        level.alias("sev"), severity_name(level).alias("severity"),
        F.concat(F.lit("Event "), kind, F.lit(", key % "), key.cast("string")).alias("message"),
        F.concat(F.lit("d"), (key % 5).cast("string"), F.lit("/f"), key.cast("string"), F.lit(".py")).alias("path"),
        F.hour("ts").cast("int").alias("line"),
        F.concat(F.lit("value: "), F.floor(F.col("value") / 20).cast("string")).alias("evidence"),
        F.lit("Look <here> & \"there\".").alias("fix"), F.lit("CWE-1").alias("cwe"), F.lit("medium").alias("confidence"),
        F.lit("events").alias("scanner"), F.lit(0).alias("scan_seq"), F.col("event_id").alias("pos"))


def commit_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as one commit of its conversation's repository."""
    turn, n = F.col("turn"), F.col("conv_id") * 7 + F.col("turn")
    secret, place = pick(PATCH_LINES, n), pick(PATCH_PATHS, n)
    body = F.concat(F.lit("+"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n+")))
    patch = F.concat(
        F.lit("diff --git a/first.txt b/first.txt\n--- a/first.txt\n+++ b/first.txt\n@@ -0,0 +1 @@\n"), body,
        F.lit("\ndiff --git a/x b/x\n--- a/"), place,
        F.when(n % 3 == 0, F.lit("\n+++ /dev/null")).otherwise(F.concat(F.lit("\n+++ b/"), place)),
        F.lit("\n@@ -1 +1 @@\n"), secret, F.lit("\n--- a/not/a/header\n"), secret, F.lit("\n"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("repo"),
        turn.cast("int").alias("commit_seq"), F.sha1(n.cast("string")).alias("commit"), patch.alias("patch"))
