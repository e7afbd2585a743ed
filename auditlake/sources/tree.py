"""Directory trees in tasks: a walk that stops at excluded directories, and a read that opens chosen files, dealt by bytes."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.globs import exclude_regex
from auditlake.session import materialize

#: Entries a task lists before it hands its open directories on: few at first, so that a tree spreads early.
FIRST_ENTRIES, ENTRIES = 200, 20_000
#: Bytes a task reads, with so many for opening a file; tasks of a bucket are cut by running sums.
TASK_BYTES, OPEN_BYTES, BUCKET_TASKS = 64_000_000, 65_536, 64
ENTRY = "rel string, size_bytes long, is_directory boolean"


def open_root(root: str):
    """(file system, path of the root in it) of a path or a URI that pyarrow opens."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        system, base = fs.FileSystem.from_uri(root)
    else:
        system, base = fs.LocalFileSystem(), root
    return system, base.rstrip("/")


def excludes_all_below(patterns):
    """A test of directories: whether exclude patterns leave out every path below one, at any depth."""
    parts = [p for p in map(exclude_regex, patterns) if p]
    if not parts:
        return lambda directory: False
    whole = re.compile("(?:" + "|".join(parts) + r")\Z")
    # a pattern without a wildcard for the rest ends at its own depth, so names no pattern spells are tried beyond all of them
    depth = 2 + max(p.count("/") for p in patterns)
    probes = ["/" + "/".join(["\x01"] * n) for n in range(1, depth + 1)]
    return lambda directory: all(whole.match(directory + probe) for probe in probes)


def list_tree(spark: SparkSession, root: str, prune=(), repo_level: bool = False, parallelism: int | None = None) -> DataFrame:
    """(rel, size_bytes) of every file below ``root``, hidden ones included, without opening any.

    Tasks list directories in rounds: each goes down its own until it has listed ENTRIES, and hands the directories that are
    still open to the next round, where they are dealt anew. A directory that the patterns of ``prune`` exclude with all
    below it is not listed; with ``repo_level`` they apply to paths below the root's own directories. Directories behind
    symbolic links of a local root are not entered. An empty or missing tree gives no rows.
    """
    patterns = list(prune)
    tasks = parallelism or 4 * spark.sparkContext.defaultParallelism

    def listing(budget: int):
        def walk(frames):
            from pyarrow import fs

            system, base = open_root(root)
            local, closed = isinstance(system, fs.LocalFileSystem), excludes_all_below(patterns)
            for frame in frames:
                waiting, rows, listed = list(frame["rel"]), [], 0
                while waiting and listed < budget:
                    at = waiting.pop()
                    for info in system.get_file_info(fs.FileSelector(f"{base}/{at}" if at else base, allow_not_found=True)):
                        rel, listed = info.path[len(base) + 1:], listed + 1
                        if info.type == fs.FileType.File:
                            rows.append((rel, info.size, False))
                        elif info.type == fs.FileType.Directory and not (local and os.path.islink(info.path)):
                            inside = rel.partition("/")[2] if repo_level else rel
                            if not inside or not closed(inside):
                                waiting.append(rel)
                rows += [(rel, None, True) for rel in waiting]
                yield pd.DataFrame(rows, columns=["rel", "size_bytes", "is_directory"]).astype({"size_bytes": "Int64"})
        return walk

    found, open_, budget = [], spark.createDataFrame([("",)], "rel string"), FIRST_ENTRIES
    while True:
        rows = materialize(open_.mapInPandas(listing(budget), ENTRY), "listing")
        found.append(rows.where("NOT is_directory").select("rel", "size_bytes"))
        left = rows.where("is_directory").select("rel")
        if left.isEmpty():
            break
        open_, budget = left.repartition(tasks), ENTRIES
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def by_bytes(listing: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``listing`` in partitions of about ``task_bytes`` of its wanted files, at least one file each.

    Files are dealt over buckets by hash; running sums inside a bucket cut it into tasks. A file larger than a task is one.
    """
    cost = F.when(F.col("wanted"), F.col("size_bytes") + OPEN_BYTES).otherwise(F.lit(16))
    total = listing.agg(F.sum(cost)).first()[0] or 0
    buckets = max(1, -(-total // (BUCKET_TASKS * task_bytes)))
    slots = min(2 * BUCKET_TASKS, -(-total // task_bytes) + 1)
    so_far = Window.partitionBy("bucket").orderBy("rel").rowsBetween(Window.unboundedPreceding, -1)
    placed = listing.withColumn("cost", cost).withColumn("bucket", F.pmod(F.xxhash64("rel"), F.lit(buckets))).withColumn(
        "task", F.col("bucket") * slots + F.pmod(F.floor(F.coalesce(F.sum("cost").over(so_far), F.lit(0)) / task_bytes), F.lit(slots)))
    return placed.repartitionById(int(buckets * slots), F.col("task").cast("int")).drop("cost", "bucket", "task")


def read_contents(listing: DataFrame, root: str, wanted: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``listing`` with ``content``: the bytes of the files that are ``wanted``, null for others, which are not opened.

    A file that is gone since it was listed has null, too.
    """
    rows = by_bytes(listing.withColumn("wanted", F.coalesce(wanted, F.lit(False))), task_bytes)

    def read(frames):
        system, base = open_root(root)

        def content(rel: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/{rel}") as stream:
                    return stream.read()
            except FileNotFoundError:
                return None

        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at:at + 64]
                yield part.assign(content=[content(r) if w else None for r, w in zip(part["rel"], part["wanted"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(read, f"{fields}, content binary").drop("wanted")
