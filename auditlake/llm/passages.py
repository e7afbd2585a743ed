"""Passages that occur more than once: shared plan of the substring and the suffix-array operator.

Both operators ask, for every window of W consecutive symbols (words or bytes), where else it occurs. Comparing
documents with each other, or every document with an index of every other shard, would grow with the square of the
corpus. Windows are therefore routed by content first:

1. Each window's *anchor* is its smallest m-gram in a hash order. Equal windows have equal anchors, so consecutive
   windows with one anchor form a *segment*, and only segments with equal anchors can share a window.
2. Anchors are counted with map-side partial sums; those of a single place are dropped. If all segments of an anchor are
   equal (copies), its sums answer for all their windows.
3. Otherwise one text per different segment is fetched and goes to the shard of its anchor, where the operator's index
   decides window by window.
4. The decided ranges go back to their documents.

No step holds a whole group: hot anchors meet as sums and in joins that adaptive execution splits, and an anchor with
very many different segments is cut into single windows, which are counted by their hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from auditlake.llm.common import slices, small_batches
from auditlake.session import materialize

BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols handled at once; longer texts are cut into pieces that overlap by a window.
PIECE = 400_000
#: Different segments of one anchor above which it is cut into single windows.
MANY = 2_000
#: Bytes of the segments that are indexed together as one shard.
SHARD = 400_000


@dataclass(frozen=True)
class Passages:
    """window, gram: W and m. symbols: text -> 64-bit symbol values. cut: text, begin, end -> bytes of these symbols."""

    window: int
    gram: int
    symbols: Callable[[str | None], np.ndarray]
    cut: Callable[[str | None, list[tuple[int, int]]], list[bytes]]


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_CACHE = _WordHashes()


def word_symbols(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint64, count=len(words))


def word_cut(text: str | None, spans: list[tuple[int, int]]) -> list[bytes]:
    words = (text or "").encode().split()
    return [b" ".join(words[a:b]) for a, b in spans]


_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)


def byte_symbols(text: str | None) -> np.ndarray:
    return _BYTES[np.frombuffer((text or "").encode(), dtype=np.uint8)]


def byte_cut(text: str | None, spans: list[tuple[int, int]]) -> list[bytes]:
    data = (text or "").encode()
    return [data[a:b] for a, b in spans]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS.update(n=n, up=np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)]),
                       down=np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols from begin to end, from running sums over the whole piece."""
    up, _ = _powers(len(sums))
    return _mixed((sums[end] - sums[begin]) * up[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def running_sums(symbols: np.ndarray) -> np.ndarray:
    _, down = _powers(len(symbols) + 1)
    # the powers fall from left to right, so that a range's sum times BASE ** begin does not depend on where it stands
    return np.r_[np.uint64(0), np.cumsum(symbols * down[:len(symbols)])]


def segments_of(symbols: np.ndarray, ends: np.ndarray, spec: Passages):
    """Segments of texts that stand one after the other in ``symbols`` (``ends``: where each ends).

    Gives arrays: text number, first window, number of windows, anchor hash, segment hash (40 bits).
    """
    n, wide, choices = len(symbols), spec.window, spec.window - spec.gram + 1
    none = np.empty(0, np.int64)
    if n < wide:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = running_sums(symbols)
    at = np.arange(n - spec.gram + 1)
    grams = range_hashes(sums, at, at + spec.gram)
    low = np.uint64((1 << 20) - 1)
    best = (grams & ~low) | at.astype(np.uint64)  # order by hash, then by place: the leftmost of equal grams
    have = 1
    while have < choices:
        step = min(have, choices - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    anchor = (best & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n - wide + 1), side="right")
    inside = np.arange(n - wide + 1) + wide <= ends[text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a, t = anchor[starts], text[starts]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    count = np.diff(np.r_[new, len(starts)])
    first = starts[new]
    whole = range_hashes(sums, first, first + count + wide - 1) >> np.uint64(24)
    return t[new], first, count, grams[a[new]], whole


def _pieces(texts: list, spec: Passages) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Symbols of many short texts together, or of a long text piece by piece: symbols, text numbers, ends, offsets."""
    held, numbers, ends, offsets, total = [], [], [], [], 0
    for i, text in enumerate(texts):
        symbols = spec.symbols(text)
        for begin in range(0, max(1, len(symbols) - spec.window + 1), PIECE):
            part = symbols[begin:begin + PIECE + spec.window - 1]
            if total and total + len(part) > PIECE:
                yield np.concatenate(held), numbers, ends, offsets
                held, numbers, ends, offsets, total = [], [], [], [], 0
            total += len(part)
            held.append(part)
            numbers.append(i)
            ends.append(total)
            offsets.append(begin - (total - len(part)))
    if held:
        yield np.concatenate(held), numbers, ends, offsets


def _places(docs: DataFrame, spec: Passages) -> DataFrame:
    """All segments: anchor, seg (hash of its symbols), doc_id, row, first window, number of windows."""
    def run(batches):
        for batch in slices(batches, "text"):
            ids, rows = batch.column("doc_id"), batch.column("row")
            for symbols, numbers, ends, offsets in _pieces(batch.column("text").to_pylist(), spec):
                t, first, count, anchor, whole = segments_of(symbols, np.array(ends), spec)
                number = pa.array(np.array(numbers)[t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), ids.take(number), rows.take(number),
                     pa.array((first + np.array(offsets)[t]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "seg", "doc_id", "row", "first", "n"])

    return docs.mapInArrow(run, "anchor long, seg long, doc_id long, row int, first int, n int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a hash of the text where ids repeat, to tell such rows apart, else 0."""
    repeated = small_batches(docs).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return docs.select("doc_id", "text", F.hash("text").alias("row") if repeated else F.lit(0).alias("row"))


def packed(docs: DataFrame) -> DataFrame:
    """Documents as they are sent to their ranges: the text compressed (null as empty), about half of what Spark would send."""
    def run(batches):
        for batch in slices(batches, "text"):
            texts = [zlib.compress((t or "").encode(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(texts, pa.binary())], names=["doc_id", "row", "packed"])

    return docs.mapInArrow(run, "doc_id long, row int, packed binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[str]:
    return (zlib.decompress(x).decode() for x in batch.column("packed").to_pylist())


def _fetch(docs: DataFrame, wanted: DataFrame, spec: Passages, width: int) -> DataFrame:
    """Texts of the wanted segments: rows of ``wanted`` with column ``words`` (bytes of the segment's symbols).

    ``wanted`` (doc_id, row, anchor, seg, first, n, least, times) has one row per different segment.
    """
    lists = wanted.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(
        F.collect_list(F.struct("anchor", "seg", "first", "n", "least", "times")).alias("want"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("row").eqNullSafe(F.col("of_row"))
    joined = packed(docs).join(lists, same).select("packed", "want")

    def run(batches):
        names = ("anchor", "seg", "n", "least", "times")
        for batch in batches:
            for text, want in zip(unpacked(batch), batch.column("want"), strict=True):
                want = want.as_py()
                cuts = spec.cut(text, [(w["first"], w["first"] + w["n"] + width - 1) for w in want])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([w[c] for w in want], pa.int32() if c == "n" else pa.int64()) for c in names), pa.array(cuts, pa.binary())],
                    names=[*names, "words"])

    return joined.mapInArrow(run, "anchor long, seg long, n int, least long, times long, words binary")


def _by_index(segments: DataFrame, index) -> DataFrame:
    """Decide the windows of segments whose anchors have several different ones: rows (anchor, seg, at, len, least, times)."""
    fields = ["anchor", "seg", "n", "least", "times", "words"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("words").nbytes
            if size < SHARD:
                continue
            table = pa.Table.from_batches(held)
            anchors = table.column("anchor").to_numpy()
            cut = np.flatnonzero(anchors != anchors[-1])
            if len(cut):  # the last anchor may go on in the next batch
                yield from index(table.slice(0, cut[-1] + 1))
                table = table.slice(cut[-1] + 1).combine_chunks()
            held, size = table.to_batches(), table.column("words").nbytes
        if held:
            yield from index(pa.Table.from_batches(held))

    ordered = segments.select(*fields).repartition("anchor").sortWithinPartitions("anchor", "seg")
    return ordered.mapInArrow(run, "anchor long, seg long, at int, len int, least long, times long")


def _by_window(segments: DataFrame, spec: Passages) -> DataFrame:
    """The same for anchors with very many segments: every window is counted by its hash."""
    def run(batches):
        for batch in batches:
            words = batch.column("words").to_pylist()
            for i, data in enumerate(words):
                symbols = spec.symbols(data.decode("utf-8", "surrogateescape")) if spec.cut is word_cut else _BYTES[np.frombuffer(data, np.uint8)]
                at = np.arange(batch.column("n")[i].as_py())
                hashes = range_hashes(running_sums(symbols), at, at + spec.window)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(at), batch.column(c)[i].as_py())) if batch.column(c)[i].is_valid else pa.nulls(len(at), pa.int64())
                       for c in ("anchor", "seg", "least", "times")), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))],
                    names=["anchor", "seg", "least", "times", "at", "hash"])

    windows = materialize(segments.mapInArrow(run, "anchor long, seg long, least long, times long, at int, hash long"), "windows")
    sums = windows.groupBy("anchor", "hash").agg(F.min("least").alias("least"), F.sum("times").alias("times"))
    return windows.drop("least", "times").join(sums, ["anchor", "hash"]).select(
        "anchor", "seg", "at", F.lit(1).alias("len"), "least", "times")


def repeated_ranges(docs: DataFrame, spec: Passages, index, by_order: bool) -> DataFrame:
    """Ranges of windows to remove: doc_id, row, ranges array<struct<first, n>>, one row per document that has any.

    by_order: a window counts if it occurs in a document with a smaller doc_id (null being the largest); otherwise if it
    occurs at two places at least.
    """
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    places = _places(docs, spec)
    sums = [F.min("seg").alias("seg_low"), F.max("seg").alias("seg_high")]
    if by_order:
        shared = places.groupBy("anchor").agg(F.min(order).alias("low"), F.max(order).alias("high"), *sums).where("low <> high")
    else:
        shared = places.groupBy("anchor").agg(F.count("*").alias("low"), *sums).where("low > 1")
    shared = shared.select("anchor", "low", F.expr("seg_low = seg_high").alias("alike"))
    hits = places.join(shared, "anchor")
    if by_order:
        hits = hits.where(~F.col("alike") | (F.col("low") < order))
    hits = materialize(hits.drop("low"), "shared-anchors")
    alike, mixed = hits.where("alike").select("doc_id", "row", "first", "n"), hits.where("NOT alike").drop("alike")

    kinds = mixed.groupBy("anchor", "seg").agg(F.min(order).alias("least"), F.count("*").alias("times"),
                                               F.min(F.struct("doc_id", "row", "first", "n")).alias("one"))
    kinds = materialize(kinds, "segments")
    spread = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    wanted = kinds.join(spread, "anchor").select("anchor", "seg", "least", "times", "kinds", "one.*")
    texts = materialize(_fetch(docs, wanted.drop("kinds"), spec, spec.window).join(spread, "anchor"), "segment-texts")
    few, many = texts.where(F.col("kinds") <= MANY), texts.where(F.col("kinds") > MANY)
    decided = _by_index(few, index).union(_by_window(many, spec))
    decided = materialize(decided if by_order else decided.where("times > 1"), "decided")

    found = mixed.join(decided.withColumnRenamed("least", "smallest"), ["anchor", "seg"])
    if by_order:
        found = found.where(F.col("smallest") < order)
    found = found.select("doc_id", "row", (F.col("first") + F.col("at")).alias("first"), F.col("len").alias("n")).union(alike)
    # equal rows (one doc_id, one text) find the same ranges: a set, so that they do not add up
    return found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))


def covered(length: int, ranges, window: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a removed window."""
    steps = np.zeros(length + 1, dtype=np.int64)
    if len(ranges):
        first = ranges.field("first").to_numpy().astype(np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, np.minimum(first + ranges.field("n").to_numpy() - 1 + window, length), -1)
    return np.cumsum(steps[:-1]) > 0


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, packed text and ranges (null: none) of all documents."""
    ranges = materialize(ranges.withColumnsRenamed({"doc_id": "of", "row": "of_row"}), "ranges")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("row").eqNullSafe(F.col("of_row"))
    return packed(docs).join(ranges, same, "left").select("doc_id", "packed", "ranges")
