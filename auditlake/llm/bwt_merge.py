"""Suffix-array duplicates: repeated byte strings found by merging Burrows-Wheeler transforms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.common import slices
from auditlake.llm.fm_index import suffix_order
from auditlake.llm.passages import Passages, byte_cut, byte_symbols, covered, keyed, repeated_ranges, unpacked, with_ranges

#: Bytes of one transform before merging.
PART = 100_000


class Transform:
    """Burrows-Wheeler transform of byte strings with a terminator after each, kept as text, suffix order and its inverse.

    The transform's symbol of a row is what stands before the row's suffix; :meth:`before` gives several symbols at once.
    """

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        values = self.text.astype(np.uint16) + 1
        values[ends] = 0
        self.terminators = np.zeros(len(values) + 1, dtype=np.int32)
        self.terminators[ends + 1] = 1
        np.cumsum(self.terminators, out=self.terminators)
        self.order = suffix_order(values)
        self.row = np.empty(len(values), dtype=np.int32)
        self.row[self.order] = np.arange(len(values), dtype=np.int32)

    def before(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: whether ``step`` symbols of its string stand before its suffix, these symbols as one number, and
        the row of the suffix that starts with them."""
        at = self.order
        fits = at >= step
        fits[fits] = self.terminators[at[fits]] == self.terminators[at[fits] - step]
        symbols = np.zeros(len(at), dtype=np.uint64)
        start = np.where(fits, at - step, 0)
        for k in range(step):
            symbols = symbols << np.uint64(8) | self.text[start + k]
        return fits, symbols, self.row[start]


def _steps(parts: list[Transform], depth: int):
    """The largest step that divides ``depth`` and whose different symbol groups fit a 16-bit distribution."""
    for step in (8, 5, 4, 2, 1):
        if depth % step:
            continue
        fits, symbols, back = (np.concatenate(x) for x in zip(*(p.before(step) for p in parts), strict=True))
        kinds, symbols = np.unique(symbols, return_inverse=True)
        if len(kinds) <= 1 << 16:
            return step, fits, symbols.astype(np.uint16), back


def merge(parts: list[Transform], depth: int) -> np.ndarray:
    """Longest prefix, up to ``depth``, that each row's suffix shares with another suffix of any part, in whole steps.

    Iterative interleave refinement (Holt and McMillan): the interleave of all rows is refined round by round. In a round,
    rows are distributed stably by the transform's symbols to the places of the suffixes that are longer by these symbols,
    so suffixes are never sorted again. As many symbols are taken per round as a 16-bit distribution allows. A row that is
    alone in its block has its common prefix decided and leaves the interleave, as no longer suffix that ends in it can
    share more. Rows are numbered through all parts.
    """
    step, fits, symbols, back = _steps(parts, depth)
    sizes = [len(p.order) for p in parts]
    back = back + np.repeat(np.cumsum([0, *sizes[:-1]]), sizes).astype(np.int32)
    common = np.zeros(len(symbols), dtype=np.int32)
    rows, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
    for length in range(step, depth + 1, step):
        more = fits[rows]
        rows, block = rows[more], block[more]
        s = symbols[rows]
        order = np.argsort(s, kind="stable")
        rows, block, s = back[rows[order]], block[order], s[order]
        if not len(rows):
            break
        new = np.empty(len(rows) + 1, dtype=bool)
        new[0] = new[-1] = True
        new[1:-1] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1], dtype=np.int32)[shared]
        rows = rows[shared]
        common[rows] = length
    return common


def _intervals(table: pa.Table, window: int):
    """Merge one shard's transforms: runs of windows that occur at two places at least."""
    texts = table.column("words").to_pylist()
    count = table.column("n").to_numpy().astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts])
    group = (np.cumsum(lengths) - lengths) // max(1, min(PART, int(lengths.sum()) // 2))
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    bounds = [*firsts.tolist(), len(texts)]
    parts = [Transform(texts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    common = merge(parts, window)
    starts = np.cumsum([0, *(len(p.order) for p in parts)])
    flags = np.zeros(int(lengths.sum()), dtype=bool)
    for part, start in zip(parts, starts, strict=False):
        flags[start + part.order] = common[start:start + len(part.order)] >= window
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begins = np.cumsum(lengths) - lengths
    repeated = flags[begins[owner] + at] | (table.column("times").to_numpy() > 1)[owner]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1])]) if len(owner) else np.empty(0, np.int64)
    run = np.diff(np.r_[new, len(owner)])
    new, run = new[repeated[new]], run[repeated[new]]
    take = pa.array(owner[new])
    yield pa.RecordBatch.from_arrays(
        [table.column("anchor").combine_chunks().take(take), table.column("seg").combine_chunks().take(take), pa.array(at[new].astype(np.int32)),
         pa.array(run.astype(np.int32)), pa.nulls(len(new), pa.int64()), pa.array(np.full(len(new), 2))],
        names=["anchor", "seg", "at", "len", "least", "times"])


def drop_repeated_strings(docs: DataFrame, window: int = 200, gram: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, joined; binary).

    Every byte of the UTF-8 text goes that is covered by a ``window``-byte string which also starts anywhere else, in the
    same document or another, overlaps included and judged on the input. n_spans counts the maximal removed runs. Null
    counts as empty. Repeated rows are separate places, so both lose what they share; further columns are ignored; an
    empty table gives no rows. A removed run may begin or end inside a character, hence binary.
    """
    spec = Passages(window, gram, byte_symbols, byte_cut)
    docs = keyed(docs)
    ranges = repeated_ranges(docs, spec, lambda table: _intervals(table, window), by_order=False)

    def run(batches):
        for batch in slices(batches, "packed"):
            counts, removed, spans, kept = [], [], [], []
            for text, found in zip(unpacked(batch), batch.column("ranges"), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = covered(len(data), found.values if found.is_valid else (), window)
                counts.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts, removed, spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ranges(docs, ranges).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
