"""Substring duplicates: word passages found by backward search in compressed FM-indexes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.common import slices
from auditlake.llm.passages import Passages, covered, keyed, repeated_ranges, unpacked, with_ranges, word_cut, word_symbols


class Bits:
    """A bit vector in 64-bit words with a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), dtype="<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit vector per bit of the symbols (Claude and Navarro)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in reversed(range(bits)):
            one = (values >> level & 1).astype(bool)
            self.levels.append((level, Bits(one), int(len(one) - one.sum())))
            values = np.concatenate((values[~one], values[one]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low = np.zeros_like(at)
        for level, bits, zeros in self.levels:
            one = (symbols >> level & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of small non-negative numbers in order.

    Prefix doubling that starts with as many symbols as fit into 63 bits and sorts again only what still shares its rank.
    """
    n, bits = len(values), max(1, int(values.max(initial=0)).bit_length())
    have = 63 // bits
    key = np.zeros(n, dtype=np.int64)
    for k in range(min(have, n)):
        key[:n - k] |= values[k:].astype(np.int64) << (bits * (have - 1 - k))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if n else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    places = np.flatnonzero(~(new & np.r_[new[1:], True]))  # a rank is the first place of those that share it
    while len(places):
        items = order[places]
        # a suffix that ends first comes first; the padding of the first keys did not tell
        after = np.where(items + have < n, rank[np.minimum(items + have, n - 1)] + have + 1, n - items)
        key = rank[items] * (n + have + 2) + after
        sort = np.argsort(key, kind="stable")
        items, key = items[sort], key[sort]
        order[places] = items
        new = np.r_[True, key[1:] != key[:-1]]
        rank[items] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        places = places[~(new & np.r_[new[1:], True])]
        have *= 2
    return order


class FMIndex:
    """FM-index of several word sequences: wavelet matrix over the Burrows-Wheeler transform, counts, owner of each row."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, least: np.ndarray):
        """words: symbols from 1 on, with 0 after every sequence (at ``ends``); least: the smallest doc_id of each sequence."""
        sizes = np.diff(np.r_[-1, ends])
        order = suffix_order(words)
        transform = words[order - 1]
        self.top = int(words.max()) + 1
        self.tree = WaveletMatrix(transform, max(1, int(self.top).bit_length()))
        self.smaller = np.r_[0, np.cumsum(np.bincount(words, minlength=self.top))]
        self.owner = np.repeat(least, sizes)[order]

    def matching_statistics(self, words: np.ndarray, last: np.ndarray, longest: int):
        """For every end position: how many words up to ``longest`` can be matched backwards, and the rows that match."""
        low = np.zeros(len(last), dtype=np.int64)
        high = np.full(len(last), len(self.owner), dtype=np.int64)
        length = np.zeros(len(last), dtype=np.int64)
        live = np.arange(len(last))
        for step in range(longest):
            live = live[last[live] - step >= 0]
            symbols = words[last[live] - step]
            known = (symbols > 0) & (symbols < self.top)
            live, symbols = live[known], symbols[known]
            a = self.smaller[symbols] + self.tree.rank(symbols, low[live])
            b = self.smaller[symbols] + self.tree.rank(symbols, high[live])
            some = b > a
            live = live[some]
            low[live], high[live] = a[some], b[some]
            length[live] += 1
        return length, low, high


def _intervals(table: pa.Table, window: int):
    """Index one shard's segments and stream them against it: runs of windows with one smallest doc_id."""
    texts = [x.split(b" ") for x in table.column("words").to_pylist()]
    least = table.column("least").to_numpy()
    flat = np.array([w for t in texts for w in (*t, b"")], dtype=object)
    numbers: dict[bytes, int] = {b"": 0}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), dtype=np.int64, count=len(flat))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    index = FMIndex(words, ends, least)
    count = table.column("n").to_numpy().astype(np.int64)
    begins = np.r_[0, ends[:-1] + 1]
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length, low, high = index.matching_statistics(words, begins[owner] + at + window - 1, window)
    if not (length == window).all():
        raise ValueError("a streamed window is missing from its own shard's index")
    # windows of one length have equal or separate row intervals, so each interval's minimum is taken once
    first, back = np.unique(low, return_inverse=True)
    size = np.zeros(len(first), dtype=np.int64)
    size[back] = high - low
    rows = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    smallest = np.minimum.reduceat(index.owner[rows], np.cumsum(size) - size)[back] if len(rows) else np.empty(0, np.int64)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1])]) if len(owner) else np.empty(0, np.int64)
    run = np.diff(np.r_[new, len(owner)])
    take = pa.array(owner[new])
    yield pa.RecordBatch.from_arrays(
        [table.column("anchor").combine_chunks().take(take), table.column("seg").combine_chunks().take(take), pa.array(at[new].astype(np.int32)),
         pa.array(run.astype(np.int32)), pa.array(smallest[new]), pa.array(np.full(len(new), 2))],
        names=["anchor", "seg", "at", "len", "least", "times"])


def drop_repeated_passages(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (its remaining words joined by one space).

    Every word goes that is covered by ``window`` consecutive words whose sequence also starts in a document with a
    smaller doc_id, judged on the input. Null and empty texts have no words. Rows with one doc_id never remove each
    other's words; null counts as the largest doc_id. Repeated rows get equal results, further columns are ignored,
    an empty table gives no rows.
    """
    spec = Passages(window, gram, word_symbols, word_cut)
    docs = keyed(docs)
    ranges = repeated_ranges(docs, spec, lambda table: _intervals(table, window), by_order=True)

    def run(batches):
        for batch in slices(batches, "packed"):
            counts, removed, kept = [], [], []
            for text, found in zip(unpacked(batch), batch.column("ranges"), strict=True):
                words = text.encode().split()
                gone = covered(len(words), found.values if found.is_valid else (), window)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return with_ranges(docs, ranges).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
