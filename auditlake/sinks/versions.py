"""Baselines in versions: a commit is seen as a whole or not at all, and any two versions can be compared.

A commit writes its entries to a folder of its own and is published by one small manifest, which names the folders that make up
the version. What breaks off before leaves a folder that no manifest names. Manifests are numbered and created only where
their number is free, so that of two commits at the same time one takes the next number, on top of the other.

A folder holds only the repositories of its scan; those of a version come from the last folder that scanned them. ``compact``
puts them into one folder again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.suppress import baseline_of
from auditlake.schemas import BASELINE

ENTRY = BASELINE.fieldNames()


class BaselineVersions:
    """The baseline versions under ``path``, in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The numbers of the published versions."""
        return sorted(self._manifests())

    def commit(self, findings: DataFrame, scanned: DataFrame | None = None) -> int:
        """Replace the baseline of the ``scanned`` repositories (default: those in ``findings``); others stay. Returns the version.

        A scanned repository without findings has an empty baseline from then on. ``findings`` must not have been filtered by an
        older baseline, or its entries would go.
        """
        return self._publish(self._write(baseline_of(findings), (findings if scanned is None else scanned).select("repo").distinct()))

    def compact(self) -> int:
        """The newest version once more, as a single folder."""
        folders = self._head()[1]
        return self._publish(self._write(self._entries(folders), self._scans(folders).select("repo").distinct()), folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The entries of a version, by default the newest; none where nothing has been published."""
        return self._entries(self._folders(version))

    def diff(self, old: int, new: int) -> DataFrame:
        """Entries that one of two versions holds more often: the entry, ``status`` (added or removed) and how many ``times``."""
        change = (self.read(new).withColumn("n", F.lit(1)).unionByName(self.read(old).withColumn("n", F.lit(-1)))
                  .groupBy(*ENTRY).agg(F.sum("n").alias("n")).where("n <> 0"))
        return change.select(*ENTRY, F.when(F.col("n") > 0, "added").otherwise("removed").alias("status"), F.abs("n").alias("times"))

    # ------------------------------------------------------------ folders

    def _write(self, entries: DataFrame, scanned: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        entries.hint("rebalance", "repo").write.partitionBy("repo").parquet(f"{self.path}/{folder}/entries")
        scanned.write.parquet(f"{self.path}/{folder}/scanned")
        return folder

    def _entries(self, folders: list[str]) -> DataFrame:
        # a repository's entries count where its last scan is
        parts = [self.spark.read.schema(BASELINE).parquet(f"{self.path}/{folder}/entries").select(*ENTRY, F.lit(n).alias("_at"))
                 for n, folder in enumerate(folders)]
        last = self._scans(folders).groupBy("repo").agg(F.max("_at").alias("_at"))
        return self._union(parts, BASELINE).join(last, ["repo", "_at"], "left_semi").select(*ENTRY)

    def _scans(self, folders: list[str]) -> DataFrame:
        return self._union([self.spark.read.schema("repo string").parquet(f"{self.path}/{folder}/scanned").withColumn("_at", F.lit(n))
                            for n, folder in enumerate(folders)], "repo string")

    def _union(self, parts: list[DataFrame], schema) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("_at", F.lit(0))
        for part in parts:
            out = out.unionByName(part)
        return out

    # ------------------------------------------------------------ manifests

    def _publish(self, folder: str, replaces: list[str] = ()) -> int:
        """Name ``folder`` in the next free manifest, after the folders of the newest version less those it ``replaces``."""
        while True:
            taken, folders = self._head()
            if replaces and folders[:len(replaces)] != list(replaces):
                raise RuntimeError("another compaction was published first")
            text = json.dumps({"folders": [folder, *folders[len(replaces):]] if replaces else [*folders, folder]})
            if self._create(taken + 1, text):
                return taken + 1

    def _create(self, number: int, text: str) -> bool:
        """Write a manifest; False where the number is taken."""
        fs, place = self._files(f"manifests/{number:012d}.json")
        try:
            stream = fs.create(place, False)
        except Exception:
            if fs.exists(place):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _head(self) -> tuple[int, list[str]]:
        """The highest number taken, also by a manifest that broke off, and the folders of the newest version."""
        fs, place = self._files("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        published = self._manifests()
        return (max([int(n[:12]) for n in names if n.endswith(".json")], default=0), published[max(published)] if published else [])

    def _folders(self, version: int | None) -> list[str]:
        published = self._manifests()
        if version is None:
            return published[max(published)] if published else []
        if version not in published:
            raise ValueError(f"no baseline version {version}")
        return published[version]

    def _manifests(self) -> dict[int, list[str]]:
        """Version and folders of each whole manifest; the files are small, one per commit."""
        fs, place = self._files("manifests")
        if not fs.exists(place):
            return {}
        out = {}
        for status in fs.listStatus(place):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode(errors="replace")
                finally:
                    stream.close()
                try:
                    out[int(name[:12])] = json.loads(text)["folders"]
                except ValueError:
                    continue    # broke off while it was written: never a version
        return out

    def _files(self, name: str):
        """The file system of the baseline, through the driver's Hadoop client, and a path in it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place
