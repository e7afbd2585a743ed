"""Documents published whole: one file per repository, written by many tasks at counted byte offsets, seen all at once.

The lines are written once in document order, in ranges. A range's bytes per repository give every range its offset in the
repository's file, so tasks fill one file side by side; a task that runs again writes the same bytes to the same places.
Files grow in a folder next to the target, which takes the target's name by one rename when every range has arrived, and is
removed when a task fails for good.

A target is a path, or a ``file:`` URI, that the driver and all executors see as one file system with writes at an offset.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from auditlake.session import materialize

FORMAT = "auditlake_documents"
#: A repository's file name is at most this long; longer ones end in a digest.
NAME_CHARS = 200
WRITTEN = "file string, at long, text string"


def local_path(path: str) -> str:
    """The path of a ``file:`` URI, or the path itself; other schemes have no writes at an offset."""
    if "://" not in path and not path.startswith("file:"):
        return path
    parts = urlparse(path)
    if parts.scheme != "file":
        raise ValueError(f"documents are written at offsets, which {parts.scheme}: paths do not offer: {path}")
    return unquote(parts.path)


def file_name(repo: str | None, extension: str) -> str:
    """The file of a repository: its quoted name; null is a name no repository can have."""
    name = "%" if repo is None else quote(repo, safe=" ").replace(".", "%2E") or "%%"
    if len(name) > NAME_CHARS:
        name = f"{name[:NAME_CHARS - 65]}~{hashlib.sha256(repo.encode()).hexdigest()}"
    return f"{name}.{extension}"


def publish_documents(lines: DataFrame, path: str, extension: str = "json", name: str | None = None) -> None:
    """Write document lines (``repo``, ``section``, ``key``, ``text``) as ``path/<repository>.<extension>``.

    All documents appear together, by one rename, or none does; an existing ``path`` is refused before anything is written.
    Lines end with a line feed. No lines give an empty folder.
    """
    target = local_path(path).rstrip("/")
    if os.path.lexists(target):
        raise FileExistsError(f"{target} is there already; documents are published to a new folder")
    spark = lines.sparkSession
    ranges = (lines.repartitionByRange("repo", "section", "key").sortWithinPartitions("repo", "section", "key")
              .select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn"), "repo",
                      F.coalesce("text", F.lit("")).alias("text")))
    kept = materialize(ranges, name or "document-lines")
    sizes = kept.groupBy("repo", "part").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    # one row per repository and range of lines
    before = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("repo", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    k, p = kept.alias("k"), placed.alias("p")
    found = k.join(p, F.col("k.repo").eqNullSafe(F.col("p.repo")) & (F.col("k.part") == F.col("p.part"))).select(
        "k.repo", "k.part", "turn", "start", "text")
    names = F.udf(lambda repo: file_name(repo, extension), "string")
    ordered = found.repartition("part", "repo").sortWithinPartitions("part", "repo", "turn")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    spark.dataSource.register(DocumentsSource)
    # a repository's name is worked out once per row in Python, beside the write, which is Python too
    (ordered.select(names("repo").alias("file"), F.col("start").alias("at"), "text")
     .write.format(FORMAT).option("path", target).option("bytes", total).mode("append").save())


class DocumentsSource(DataSource):
    """Rows (file, start of their range, text) in line order, as the files of one new folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite):
        return DocumentsWriter(self.options["path"], int(self.options["bytes"]))


@dataclass
class Wrote(WriterCommitMessage):
    bytes: int


class DocumentsWriter(DataSourceWriter):
    def __init__(self, target: str, total: int):
        self.target, self.total = target, total
        self.growing = os.path.join(os.path.dirname(target) or ".", f".{os.path.basename(target)}-{uuid.uuid4().hex}")

    def write(self, iterator) -> Wrote:
        os.makedirs(self.growing, exist_ok=True)
        total, now, out, spot = 0, None, None, 0
        try:
            for row in iterator:
                if (row["file"], row["at"]) != now:
                    now, spot = (row["file"], row["at"]), row["at"]
                    if out is not None:
                        out.close()
                    out = os.fdopen(os.open(os.path.join(self.growing, now[0]), os.O_CREAT | os.O_WRONLY, 0o644), "wb")
                    out.seek(spot)
                total += out.write(row["text"].encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Wrote(total)

    def commit(self, messages) -> None:
        wrote = sum(m.bytes for m in messages if m is not None)
        if wrote != self.total:
            shutil.rmtree(self.growing, ignore_errors=True)
            raise OSError(f"{wrote} of {self.total} bytes of documents arrived; nothing is published")
        os.makedirs(self.growing, exist_ok=True)
        os.rename(self.growing, self.target)

    def abort(self, messages) -> None:
        shutil.rmtree(self.growing, ignore_errors=True)
