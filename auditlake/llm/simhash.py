"""SimHash near-duplicates through an inverted index on the positional bytes of the fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditlake.llm.common import components, free_name, slices, small_batches
from auditlake.session import materialize

SEED = 42
#: Above this many fingerprints in a posting, partners are looked up by bit mask instead of compared in turn.
DENSE = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text: A-Z lower-cased, words by ASCII white space, shingles with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[s:e], SEED) for s, e in spans), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text never needs all its bits unpacked at once
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` and its fingerprints as signed longs in column ``name``."""
    def run(batches):
        for part in slices(batches, text):
            prints = np.array([fingerprint(t, shingle) for t in part.column(text).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints.view(np.int64))], names=[*part.schema.names, name])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _masks(max_bits: int) -> list[int]:
    """For each choice of the byte positions that must agree: the mask of their bits, as a signed long."""
    keep = 8 - max_bits
    masks = (sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), keep))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Indexes of the pairs that join two parts not joined by earlier pairs."""
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _verified(prints: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: pairs sharing at least 8 - max_bits positional bytes and differing in few bits."""
    diff = (prints[left] ^ prints[right])
    tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = tally >= 8 - max_bits
    ok[ok] = np.bitwise_count(diff[ok]) <= max_bits
    return ok


def _dense(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one large posting: every fingerprint looks up those that differ in 1 to max_bits bits."""
    order = np.argsort(prints)
    ranked, free = prints[order], np.uint64(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    left, right = [], []
    for n in range(1, max_bits + 1):
        for chosen in combinations(bits, n):
            wanted = ranked ^ np.bitwise_or.reduce(np.array(chosen, dtype=np.uint64))
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == wanted) & (ranked < wanted))
            left.append(order[hit])
            right.append(order[at[hit]])
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _links_of(slot: np.ndarray, key: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within complete postings, sorted by (slot, key): a spanning forest of each posting's verified pairs."""
    first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.r_[first, len(key)])
    run = np.repeat(np.arange(len(first)), size)
    sparse = np.repeat(size <= DENSE, size)
    left, right = [], []
    for step in range(1, int(min(size.max(initial=0), DENSE))):
        i = np.flatnonzero((run[:-step] == run[step:]) & sparse[:-step])
        left.append(i)
        right.append(i + step)
    for k in np.flatnonzero(size > DENSE):
        a, b = _dense(prints[first[k]:first[k] + size[k]], max_bits)
        left.append(a + first[k])
        right.append(b + first[k])
    left, right = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (left, right))
    ok = _verified(prints, left, right, max_bits)
    a, b = prints[left[ok]], prints[right[ok]]
    kept = _forest(a.tolist(), b.tolist())
    return a[kept], b[kept]


def fingerprint_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``max_bits`` bits of each other.

    A pair that differs in at most ``max_bits`` bits shares at least 8 - max_bits of its 8 positional bytes, the
    guaranteed minimum. The inverted index therefore posts each fingerprint under every choice of that many byte
    positions with their values; random texts do not meet there, as they would under single bytes. A posting holds
    at most 256 ** max_bits different fingerprints. It is read as a sorted stream; its pairs are tallied, verified
    and reduced to a spanning forest before anything is returned, so output stays linear in the postings.
    """
    masks = _masks(max_bits)
    posts = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("slot", "key"))
    posts = posts.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is None:
                now, rest = rest, None
            else:
                got = [np.asarray(batch.column(c)) for c in ("slot", "key", "fp")]
                got = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
                cut = np.flatnonzero((got[0] != got[0][-1]) | (got[1] != got[1][-1]))
                cut = cut[-1] + 1 if len(cut) else 0  # the last posting may go on in the next batch
                now, rest = [x[:cut] for x in got], [x[cut:] for x in got]
            if now is not None and len(now[0]):
                a, b = _links_of(now[0], now[1], now[2].view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return posts.mapInArrow(run, "a long, b long")


def _with_end(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _classes(marked: DataFrame, name: str, max_bits: int) -> DataFrame:
    """Per distinct fingerprint (``fp``): the root of its component and the component's smallest doc_id."""
    reps = materialize(marked.groupBy(F.col(name).alias("fp")).agg(F.min("doc_id").alias("least_id")), "prints")
    roots = components(fingerprint_links(reps.select("fp"), max_bits))
    full = materialize(reps.join(roots, reps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    return full.join(full.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows stay; rows without doc_id are linked but never name a component unless all its ids
    are null. Further columns are ignored; an empty table gives no rows.
    """
    marked = materialize(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "doc-prints")
    classes = _classes(marked, "fp", max_bits)
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: one that carries the component's smallest doc_id.

    Of several rows with that doc_id the one with the smallest text stays. Columns are unchanged, whatever their names.
    """
    name, root, least, turn = (free_name(docs, x) for x in ("fp", "root", "component_id", "turn"))
    marked = with_fingerprints(docs, name, shingle)
    narrow = materialize(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "doc-prints")
    classes = _classes(narrow, "fp", max_bits).select(F.col("fp").alias(name), F.col("root").alias(root), F.col("component_id").alias(least))
    kept = marked.join(classes, name).where(F.col("doc_id").eqNullSafe(F.col(least)))
    first = Window.partitionBy(root).orderBy("text", *[c for c in docs.columns if c not in ("text", "doc_id")])
    return kept.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).select(*docs.columns)
