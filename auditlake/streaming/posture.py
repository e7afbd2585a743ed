"""A standing posture: scores that follow files as they arrive, change and go.

The files stream needs repo, path, size_bytes, text and ``seq``, which grows with every version of a file. The state of a
(repo, path) holds the version seen last and its severity counts; states are kept in buckets of files. A newer version
replaces it; a version seen before or an older one changes nothing; a null text takes the file away. What the states emit are
changes of counts, which add up: the posture of a repository is the sum of its changes, in whatever order and batches the
files came.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.functions.severity import SEVERITIES, WEIGHTS
from auditlake.operators.file_scan import scan_files
from auditlake.operators.score import graded
from auditlake.operators.settings import RepoSettings
from auditlake.options import ScanOptions
from auditlake.schemas import KEY
from auditlake.sources.files import discover

LEVELS = len(SEVERITIES)
CHANGE = "repo string, path string, seq long, files long, " + ", ".join(f"{name} long" for name in SEVERITIES)
STATE = "files binary"
#: Groups the files' states are kept in. A call per group, not per file, goes through Python; a checkpoint keeps its number.
BUCKETS = 1024


def start_posture(files: DataFrame, out: str, checkpoint: str, options: ScanOptions | RepoSettings | None = None, **rules):
    """Write the changes of each micro-batch to ``out/batch=…``, a row per repository; a retried batch overwrites itself.

    ``out`` and ``checkpoint`` lie in a folder all executors share. ``rules`` are passed on to the file pass. The query ends
    when all files that have arrived are taken in.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sums = [F.sum(c).alias(c) for c in ("files", *SEVERITIES)]
        batch.groupBy("repo").agg(*sums).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (file_changes(files, options, **rules).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def file_changes(files: DataFrame, options: ScanOptions | RepoSettings | None = None, buckets: int = BUCKETS, **rules) -> DataFrame:
    """Changes of severity counts per file version that counts, as a stream.

    The file pass stays in the rows of the files; what is shuffled to the states is one narrow row per finding (severity and
    a hash of its key) and one per version, so that a file without findings is heard of, too. They go by a hash of repository
    and path to ``buckets`` groups, whose files are compared with their states together.
    """
    options = options or ScanOptions()
    files = files.where("seq is not null")
    versions = files.select("repo", "path", "seq", F.col("text").isNotNull().alias("present"),
                            F.lit(0).cast("long").alias("finding"), F.lit(-1).alias("sev"))
    found = scan_files(discover(files.where("text is not null"), options), options, carry=("seq",), **rules).where("not ignored")
    rows = versions.unionByName(found.select(
        "repo", "path", "seq", F.lit(True).alias("present"), F.xxhash64(*KEY).alias("finding"), "sev"))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandasWithState(replace_versions, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def replace_version(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change that the newest version among ``parts`` makes to the file ``key``; nothing where the state knows it already."""
    yield from replace_versions(key, (part.assign(repo=key[0], path=key[1]) for part in parts), state)


def replace_versions(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change that the newest version among ``parts`` makes to each of their files; nothing for those whose state knows it.

    The state holds a row per file of the group: repo, path, seq, whether it is there, and its counts.
    """
    names = ["repo", "path", "seq", "present", *SEVERITIES]
    known = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else pd.DataFrame(columns=names)
    rows = None
    for part in parts:
        part = part[part["seq"].notna()]
        part = pd.DataFrame({"repo": part["repo"].astype(object), "path": part["path"].astype(object), "seq": part["seq"].to_numpy(np.int64),
                             "present": part["present"].to_numpy(bool), "finding": part["finding"].fillna(0).to_numpy(np.int64),
                             "sev": part["sev"].fillna(-1).to_numpy(np.int64)})
        rows = part if rows is None else pd.concat([rows, part], ignore_index=True)
        # of versions that arrive together only the newest counts
        rows = rows[rows["seq"] == rows.groupby(["repo", "path"], dropna=False, sort=False)["seq"].transform("max")]
    if rows is None or rows.empty:
        return
    file = pd.concat([known[["repo", "path"]], rows[["repo", "path"]]], ignore_index=True).groupby(
        ["repo", "path"], dropna=False, sort=False).ngroup().to_numpy()
    old, file = file[:len(known)], file[len(known):]
    n = max(old.max(initial=-1), file.max()) + 1
    seqs, before, there = np.zeros(n, np.int64), np.zeros((n, LEVELS), np.int64), np.zeros(n, bool)
    seqs[old], before[old], there[old] = known["seq"], known[list(SEVERITIES)], known["present"]
    heard = np.zeros(n, bool)
    heard[old] = True
    newer = ~heard[file] | (rows["seq"].to_numpy() > seqs[file])
    rows, file = rows[newer], file[newer]
    if rows.empty:
        return
    changed, first = np.unique(file, return_index=True)
    present = np.zeros(n, bool)
    np.logical_or.at(present, file, rows["present"].to_numpy())
    hits = (rows["sev"].to_numpy() >= 0) & present[file]
    counts = count_levels(rows["finding"].to_numpy()[hits], rows["sev"].to_numpy()[hits], file[hits], n)
    now = rows.iloc[first][["repo", "path", "seq"]].reset_index(drop=True)
    state_rows = now.assign(present=present[changed], **dict(zip(SEVERITIES, counts[changed].T)))
    kept = known[~np.isin(old, changed)]
    kept = state_rows if kept.empty else pd.concat([kept, state_rows], ignore_index=True)
    stored = io.BytesIO()
    kept.to_feather(stored, compression="uncompressed")
    state.update((stored.getvalue(),))
    yield now.assign(files=present[changed].astype(np.int64) - there[changed], **dict(zip(SEVERITIES, (counts - before)[changed].T)))


def count_levels(hashes: np.ndarray, levels: np.ndarray, file: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """Findings per severity, those of one key once, by their worst severity; with ``file``, a row for each of ``n`` files."""
    of = np.zeros(len(hashes), np.int64) if file is None else file
    order = np.lexsort((-levels, hashes, of))
    hashes, levels, of = hashes[order], levels[order], of[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[:len(hashes)]
    counts = np.bincount(of[first] * LEVELS + levels[first], minlength=n * LEVELS).reshape(n, LEVELS)
    return counts[0] if file is None else counts


def standing_posture(spark: SparkSession, out: str) -> DataFrame:
    """Score, grade and counts of every repository that has had a file, from all changes written so far."""
    return _posture(_changes(spark, out).groupBy("repo").agg(*[F.sum(c).alias(c) for c in ("files", *SEVERITIES)]), ["repo"])


def posture_history(spark: SparkSession, out: str) -> DataFrame:
    """The posture of each repository after each micro-batch that changed it."""
    upto = Window.partitionBy("repo").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return _posture(_changes(spark, out).withColumns({c: F.sum(c).over(upto) for c in ("files", *SEVERITIES)}), ["repo", "batch"])


def _changes(spark: SparkSession, out: str) -> DataFrame:
    schema = "repo string, files long, " + ", ".join(f"{name} long" for name in SEVERITIES) + ", batch long"
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def _posture(counts: DataFrame, by: list[str]) -> DataFrame:
    worst = F.greatest(F.lit(-1), *[F.when(F.col(name) > 0, F.lit(level)) for level, name in enumerate(SEVERITIES)])
    return graded(counts.withColumns({
        "deductions": sum((F.col(name) * WEIGHTS[name] for name in SEVERITIES), F.lit(0)), "worst": worst,
        "findings": sum((F.col(name) for name in SEVERITIES), F.lit(0))}), [*by, "files"])
