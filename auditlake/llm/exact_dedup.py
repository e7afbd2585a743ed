"""Exact duplicates through an index of cuckoo filters over live content digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from auditlake.session import materialize

SLOTS = 4
MAX_LOAD = 0.85
MAX_ROUNDS = 200
#: Rows of an index shard: a shard is updated in one task, so its size is fixed and their number grows.
SHARD_ROWS = 200_000
ENTRY = "shard int, digest binary, n long, keep_id long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a digest's two buckets follow from its hash. Supports deletion."""

    def __init__(self, room: int):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, room) / SLOTS / MAX_LOAD))))
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.dice = np.random.default_rng(7)

    def _print(self, hashes):
        return ((hashes >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)

    def _first(self, hashes):
        return (hashes & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, at, prints):
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, at = self._print(hashes), self._first(hashes)
        return ((self.table[at] == prints[:, None]) | (self.table[self._other(at, prints)] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Insert all; False on overflow (the filter must then be rebuilt from the stored keys)."""
        prints, at = self._print(hashes), self._first(hashes)
        fresh = np.ones(len(at), dtype=bool)  # has not tried its other bucket yet
        for _ in range(MAX_ROUNDS):
            if not len(at):
                return True
            _, one = np.unique(at, return_index=True)  # one item per bucket and round
            free = self.table[at[one]] == 0
            room = free.any(axis=1)
            put = one[room]
            self.table[at[put], free[room].argmax(axis=1)] = prints[put]
            full = one[~room]
            kick = full[~fresh[full]]
            slot = self.dice.integers(0, SLOTS, len(kick))
            victims = self.table[at[kick], slot].copy()
            self.table[at[kick], slot] = prints[kick]
            prints[kick] = victims
            at[full] = self._other(at[full], prints[full])
            fresh[full] = False
            left = np.ones(len(at), dtype=bool)
            left[put] = False
            prints, at, fresh = prints[left], at[left], fresh[left]
        return not len(at)

    def delete(self, hashes: np.ndarray) -> None:
        """Remove one fingerprint per digest; only digests that were inserted may be deleted."""
        prints, at = self._print(hashes), self._first(hashes)
        for p, i, j in zip(prints, at, self._other(at, prints), strict=True):
            k = i if (self.table[i] == p).any() else j
            self.table[k, (self.table[k] == p).argmax()] = 0


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)[:, 0].copy()


class LiveDigests:
    """Filter, stored keys with their counts and the largest doc_id, for one shard or one task's share of rows."""

    def __init__(self):
        self.entries: dict[bytes, list] = {}  # bucketed content: whole 32-byte digest -> [rows, largest doc_id]
        self.filter = CuckooFilter(1024)

    def _grow(self):
        self.filter = CuckooFilter(2 * self.filter.buckets * SLOTS)
        while self.entries and not self.filter.insert(_hashes(list(self.entries))):
            self.filter = CuckooFilter(2 * self.filter.buckets * SLOTS)

    def insert(self, digests, counts, ids) -> None:
        new = {}
        for digest, n, doc, hit in zip(digests, counts, ids, self.filter.contains(_hashes(digests)) if len(digests) else (), strict=True):
            # a miss is certainly new to the index; a hit must be verified by its content's whole digest
            entry = (self.entries.get(digest) if hit else None) or new.get(digest)
            if entry is None:
                new[digest] = [n, doc]
            else:
                entry[0] += n
                entry[1] = doc if entry[1] is None or (doc is not None and doc > entry[1]) else entry[1]
        self.entries.update(new)
        if len(self.entries) > MAX_LOAD * SLOTS * self.filter.buckets or not self.filter.insert(_hashes(list(new))):
            while True:
                self._grow()
                if len(self.entries) <= MAX_LOAD * SLOTS * self.filter.buckets:
                    break

    def delete(self, digests, counts) -> None:
        """Take rows away; a digest without rows leaves the filter and the stored keys."""
        gone = []
        for digest, n, hit in zip(digests, counts, self.filter.contains(_hashes(digests)) if len(digests) else (), strict=True):
            entry = self.entries.get(digest) if hit else None
            if entry is not None:
                entry[0] -= n
                if entry[0] <= 0:
                    gone.append(digest)
                    del self.entries[digest]
        if gone:
            self.filter.delete(_hashes(gone))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"digest": list(self.entries), "n": pd.array([e[0] for e in self.entries.values()], dtype="Int64"),
                             "keep_id": pd.array([e[1] for e in self.entries.values()], dtype="Int64")})


def _ids(column) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the unchanged text in UTF-8, null counting as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def _share(rows: DataFrame, shards: int) -> DataFrame:
    """Add up each task's rows per digest in a local index first, so a digest of a third of all rows is sent once per task."""
    def run(frames):
        local = LiveDigests()
        for frame in frames:
            local.insert(list(map(bytes, frame["digest"])), frame["n"].tolist(), _ids(frame["doc_id"]))
            if len(local.entries) >= SHARD_ROWS:
                yield local.rows()
                local = LiveDigests()
        yield local.rows()

    added = rows.mapInPandas(run, "digest binary, n long, keep_id long")
    return added.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def insert(rows: DataFrame, index: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """Index after inserting ``rows`` (doc_id, digest): one row per live digest with count and largest doc_id.

    The index is a table partitioned by ``shard``; each task rebuilds its shard's filter from the stored keys, looks
    the new digests up and verifies hits. ``shards`` is taken from the number of rows unless given, and must stay the
    same over the life of an index. A digest that was deleted and comes back counts anew.
    """
    if shards is None:
        shards = max(1, -(-rows.count() // SHARD_ROWS))
    added = _share(rows.withColumn("n", F.lit(1)), shards).withColumn("old", F.lit(False))
    if index is not None:
        added = added.unionByName(index.withColumn("old", F.lit(True)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        live = LiveDigests()
        for _, part in frame.groupby(~frame["old"]):  # stored keys first, then what is new
            live.insert(list(map(bytes, part["digest"])), part["n"].tolist(), _ids(part["keep_id"]))
        return live.rows().assign(shard=int(frame["shard"].iloc[0]))

    return added.groupBy("shard").applyInPandas(run, ENTRY)


def delete(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Index after deleting ``rows`` (doc_id, digest). Digests that are not live are ignored; a digest leaves the index
    with its last row, and until then keeps the largest doc_id ever inserted."""
    gone = _share(rows.withColumn("n", F.lit(1)), shards).withColumn("old", F.lit(False))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        live, new = LiveDigests(), frame[~frame["old"]]
        part = frame[frame["old"]]
        live.insert(list(map(bytes, part["digest"])), part["n"].tolist(), _ids(part["keep_id"]))
        live.delete(list(map(bytes, new["digest"])), new["n"].tolist())
        return live.rows().assign(shard=int(frame["shard"].iloc[0]))

    return gone.unionByName(index.withColumn("old", F.lit(True))).groupBy("shard").applyInPandas(run, ENTRY)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null counts as empty, nothing is normalised. Of repeated rows
    with that doc_id all say kept: they are one document. Rows without doc_id never stay beside one with it; a group
    without any has keep_id null and kept true. Further columns are ignored; an empty table gives no rows.
    """
    rows = materialize(digests(docs), "digests")
    index = insert(rows).select("digest", "n", "keep_id")
    return rows.join(index, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
