"""File tables: reading a tree, discovery and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.globs import is_excluded
from auditlake.functions.text import basename, decode_utf8, is_dockerfile, suffix
from auditlake.operators.catalog import SCANNED_EXTENSIONS, SCANNED_NAMES
from auditlake.operators.dependencies import is_manifest
from auditlake.operators.settings import RepoSettings
from auditlake.options import ScanOptions
from auditlake.sources.tree import TASK_BYTES, list_tree, read_contents


def read_tree(spark: SparkSession, root: str, repo: str | None = None, tracked: DataFrame | None = None,
              parallelism: int | None = None, options: ScanOptions | RepoSettings | None = None, prune: bool = False,
              task_bytes: int = TASK_BYTES) -> DataFrame:
    """A directory tree, hidden files included, as a files table.

    ``root`` is a path or a URI that pyarrow opens, in a place all executors reach. With ``repo=None`` the first directory
    below it names the repository. ``tracked`` lists the (repo, path) pairs under version control; where it has none of a
    repository, or is not given, ``tracked`` is null: unknown, which the checks of tracked files report as skipped.

    Tasks list the tree first, then read files in portions of about ``task_bytes``. With ``options`` only files that a scan with
    them reads are opened: those it discovers, manifests and ignore files at a repository's root. All others keep their row, with
    size and null text, so that checks of names and sizes and the count of skipped files stay complete. ``prune`` also leaves
    directories unlisted that the excludes of ``options`` leave out as a whole; files below them have no row.
    """
    if prune and not isinstance(options, ScanOptions):
        raise ValueError("prune needs options that hold for all repositories")
    listed = list_tree(spark, root, options.excludes if prune else (), repo is None, parallelism)
    if repo is None:
        rows = listed.where(F.instr("rel", "/") > 0).select(
            "rel", F.substring_index("rel", "/", 1).alias("repo"), F.substr("rel", F.instr("rel", "/") + 1).alias("path"), "size_bytes")
    else:
        rows = listed.select("rel", F.lit(repo).alias("repo"), F.col("rel").alias("path"), "size_bytes")
    wanted, path = F.lit(True), F.col("path")
    if options is not None:
        if isinstance(options, RepoSettings):
            rows = options.attach(rows)
        excluded, too_big = _leaves_out(options)
        wanted = (~excluded & ~too_big & is_scannable(path)) | is_manifest(path) | path.isin(".gitignore", ".dockerignore")
    rows = rows.withColumn("opened", wanted).select("rel", "repo", "path", "size_bytes", "opened")
    rows = read_contents(rows, root, F.col("opened"), task_bytes).withColumn("text", decode_utf8(F.col("content"))).drop("rel", "opened", "content")
    if tracked is None:
        return rows.withColumn("tracked", F.lit(None).cast("boolean"))
    listed = tracked.select("repo", "path").distinct().withColumn("listed", F.lit(True))
    known = tracked.select("repo").distinct().withColumn("known", F.lit(True))
    return (rows.join(listed, ["repo", "path"], "left").join(known, "repo", "left")
            .select("repo", "path", "size_bytes", "text", F.when(F.col("known"), F.coalesce("listed", F.lit(False))).alias("tracked")))


def is_scannable(path: Column) -> Column:
    name = basename(path)
    return (suffix(F.lower(name)).isin(*SCANNED_EXTENSIONS) | is_dockerfile(path)
            | name.isin(*SCANNED_NAMES) | name.startswith(".env"))


def escapes_root(path: Column) -> Column:
    """Absolute paths and paths that climb out of the repository."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, part: F.when(part == "..", F.struct((s["at"] - 1).alias("at"), F.least(s["low"], s["at"] - 1).alias("low")))
        .when(part.isin("", "."), s)
        .otherwise(F.struct((s["at"] + 1).alias("at"), s["low"].alias("low"))),
        lambda s: s["low"])
    return path.startswith("/") | (depth < 0)


def changed_since(changed_files: DataFrame) -> DataFrame:
    """Committed, uncommitted and untracked changes as one list."""
    return changed_files.where(F.col("kind").isin("committed", "uncommitted", "untracked")).select(
        "repo", "path").distinct()


def staged(changed_files: DataFrame) -> DataFrame:
    return changed_files.where("kind = 'staged'").select("repo", "path").distinct()


def _leaves_out(options: ScanOptions | RepoSettings) -> tuple[Column, Column]:
    """Whether a file is excluded, and whether it is too big, by the options of all or the settings of its row."""
    if isinstance(options, RepoSettings):
        return options.is_excluded(F.col("path")), options.too_big()
    return is_excluded(F.col("path"), options.excludes), _too_big(options)


def _too_big(options: ScanOptions) -> Column:
    return F.lit(False) if options.max_file_bytes is None else F.col("size_bytes") > options.max_file_bytes


def discover(files: DataFrame, options: ScanOptions | RepoSettings | None = None,
             only: DataFrame | None = None) -> DataFrame:
    """Files a scan reads. A restricted list replaces the extension filter.

    All conditions are on path and size, so they run before the text column is touched. With settings per repository, rows
    keep them in a column for the scan.
    """
    options = options or ScanOptions()
    if isinstance(options, RepoSettings):
        files = options.attach(files)
    excluded, too_big = _leaves_out(options)
    fits = ~excluded & ~too_big
    if only is None:
        return files.where(fits & is_scannable(F.col("path")))
    listed = only.select("repo", "path").distinct()
    return files.where(fits & ~escapes_root(F.col("path"))).join(listed, ["repo", "path"], "left_semi")


def discovery_stats(files: DataFrame, options: ScanOptions | RepoSettings | None = None,
                    only: DataFrame | None = None) -> DataFrame:
    """files_scanned and files_skipped per repository, from paths and sizes alone."""
    options = options or ScanOptions()
    files = files.select("repo", "path", "size_bytes")
    if isinstance(options, RepoSettings):
        files = options.attach(files)
    excluded, too_big = _leaves_out(options)
    if only is None:
        known = is_scannable(F.col("path"))
        return files.groupBy("repo").agg(
            F.count_if(~excluded & known & ~too_big).alias("files_scanned"),
            F.count_if(excluded | (known & too_big)).alias("files_skipped"))
    listed = only.select("repo", "path").distinct()
    present = files.withColumn("present", F.lit(True))
    usable = F.coalesce("present", F.lit(False)) & ~excluded & ~too_big & ~escapes_root(F.col("path"))
    counted = (listed.join(present, ["repo", "path"], "left")
               .withColumn("ok", F.coalesce(usable, F.lit(False)))
               .groupBy("repo").agg(F.count_if("ok").alias("files_scanned"),
                                    F.count_if(~F.col("ok")).alias("files_skipped")))
    return files.select("repo").distinct().join(counted, "repo", "left").na.fill(0)
