"""Ranked lexical search: documents are scanned for all terms of the items at once, by an Aho-Corasick automaton."""

from __future__ import annotations

import math
from collections import Counter
from hashlib import sha256
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from auditlake.llm.common import slices, small_batches

#: Bytes of distinct item terms searched for in one pass over the documents. Items are dealt over as many passes as that takes.
BLOCK_BYTES = 2_000_000
#: Longer terms take part under a digest of this many letters, in items and documents alike, so the automaton stays small.
LONG = 256
#: Additions to scores that are spelled out at once.
ADDITIONS = 2_000_000
#: Tasks whose best rows are ranked together before all are.
TASKS = 64

#: In UTF-8: A-Z in lower case, digits, letters and all bytes beyond ASCII unchanged, everything else a guard.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def fold(text: str) -> tuple[str, int]:
    """``text`` with each term between single-character guards, and the number of its terms."""
    data = b" " + text.encode().translate(FOLD) + b" "
    sizes = np.diff(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)) - 1
    if sizes.max(initial=0) > LONG:
        data = b" ".join(b"\x01" + sha256(w).hexdigest().encode() if len(w) > LONG else w for w in data.split(b" "))
    return data.decode(), int((sizes > 0).sum())


def terms(text: str | None) -> list[str]:
    """The distinct terms of a text in the form the automaton holds them, sorted."""
    return sorted(set(fold(text)[0].split(" ")) - {""}) if text else []


def automaton(words: list[str]) -> ahocorasick.Automaton | None:
    """An automaton that reports word i, standing between guards, as i."""
    built = ahocorasick.Automaton()
    for i, word in enumerate(words):
        built.add_word(f" {word} ", i)
    if not words:
        return None
    built.make_automaton()
    return built


def scan(machine, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and per (text, item term) found: text, term, occurrences."""
    sizes, rows, ids, counts = np.zeros(len(texts), dtype=np.int64), [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        body, sizes[i] = fold(text)
        found = Counter(map(itemgetter(1), machine.iter(body)))
        rows.append(np.full(len(found), i, dtype=np.int64))
        ids.append(np.fromiter(found.keys(), dtype=np.int64, count=len(found)))
        counts.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return sizes, join(rows), join(ids), join(counts)


class Best:
    """The ``top`` best rows of each item among those seen so far: by score, then by doc_id, a null one last."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.rows = top, np.ones(items, dtype=np.int64), np.zeros((4, 0), dtype=np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        """``scores``: a row per document and a column per item."""
        row, item = np.nonzero(scores >= self.least)
        self.new.append(np.stack([item, scores[row, item], nulls[row], docs[row]]))
        self.waiting += len(row)
        if self.waiting > 8 * self.top * len(self.least) + 10_000:
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        begin = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - begin
        self.rows, self.new, self.waiting = rows[:, place < self.top], [], 0
        last = rows[:, place == self.top - 1]
        self.least[last[0]] = last[1]
        return self.rows


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def statistics(docs: DataFrame, words, text: str) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and the documents that hold each of ``words``; one sum per task and word."""
    def run(batches):
        known = words.value
        machine, holding, n_docs, n_terms = automaton(known), np.zeros(len(known), dtype=np.int64), 0, 0
        for part in slices(batches, text):
            sizes, _, ids, _ = scan(machine, part.column(text).to_pylist())
            n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
            holding += np.bincount(ids, minlength=len(known))
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[holding[at], n_docs, n_terms])], names=["term", "n"])

    sums = small_batches(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r.term: r.n for r in sums}
    return by_term.pop(-1, 0), by_term.pop(-2, 0), by_term


def best_rows(docs: DataFrame, words, held, numbers, top: int, doc_id: str, text: str) -> DataFrame:
    """(item, doc_id, score, task): the ``top`` best rows of each item within each task.

    ``held``: for each item, the numbers of its terms; ``numbers``: N, L and the terms' document counts.
    """
    def run(batches):
        n_docs, n_terms, holding = numbers.value
        machine, items = automaton(words.value), held.value
        weights = np.zeros(len(words.value), dtype=np.int64)
        for term, n in holding.items():
            weights[term] = weight(n_docs, n)
        sizes = np.array([len(i) for i in items], dtype=np.int64)
        of_term = np.concatenate([np.asarray(i, dtype=np.int64) for i in items])
        by_term = np.argsort(of_term, kind="stable")
        item_of, many = np.repeat(np.arange(len(items)), sizes)[by_term], np.bincount(of_term, minlength=len(weights))
        first = np.cumsum(many) - many
        best = Best(len(items), top)
        for part in slices(batches, text):
            ids = part.column(doc_id)
            docs_here, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            n, row, term, tf = scan(machine, part.column(text).to_pylist())
            # places of a document's length relative to the mean; whole numbers of any size
            norm = np.array([100 - 90 + (90 * int(x) * n_docs) // n_terms if x else 0 for x in n], dtype=np.int64)
            points = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[row]))
            each = np.bincount(row, weights=many[term], minlength=len(n)).astype(np.int64)
            width = max(1, ADDITIONS // len(items))
            start = 0
            while start < len(n):
                end = min(len(n), start + width, max(start + 1, start + int(np.searchsorted(np.cumsum(each[start:]), ADDITIONS))))
                a, b = np.searchsorted(row, (start, end))
                count = many[term[a:b]]
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[term[a:b]], count)
                scores = np.zeros((end - start, len(items)), dtype=np.int64)
                np.add.at(scores, (np.repeat(row[a:b] - start, count), item_of[place]), np.repeat(points[a:b], count))
                best.add(scores, docs_here[start:end], nulls[start:end])
                start = end
        item, score, null, doc = best.settle()
        task = np.full(len(item), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(score), pa.array(task)],
                                         names=["item", "doc_id", "score", "task"])

    return small_batches(docs).mapInArrow(run, "item long, doc_id long, score long, task long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, item_id: str = "item_id", doc_id: str = "doc_id",
                   text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score.

    Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. A document's score
    is the sum over the item's different terms of their weight and saturated frequency, in whole numbers; only scores above 0
    are ranked, equal ones by doc_id (an integer column), a null one last. Every row of ``docs`` is a document, every row of
    ``items`` an item: repeated rows are ranked each by itself. Null and empty texts have no terms; items without any, and any
    item where ``docs`` is empty, give no rows. Other columns are ignored.

    Items are dealt over passes of about ``block_bytes`` of different terms (an item is never split), whose automaton is sent to
    every task: the driver holds one pass's terms and their document counts. A pass reads the documents twice, for the counts and
    for the scores, and keeps ``top`` rows per item and task; no term of a document is stored or shuffled.
    """
    spark = docs.sparkSession
    id_field = StructField("item_id", items.schema[item_id].dataType)
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def words_of(batches):
        for part in slices(batches, "text"):
            found = [terms(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    listed = small_batches(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))).mapInArrow(
        words_of, StructType([id_field, StructField("terms", ArrayType(StringType()))]))
    size = listed.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t)))).first()[0] or 0
    passes = max(1, -(-size // block_bytes))
    out = None
    for k in range(passes):
        here = listed.where(F.size("terms") > 0).where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == k).collect()
        known = sorted({t for r in here for t in r.terms})
        if not known:
            continue
        at = {t: i for i, t in enumerate(known)}
        words, held = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast([[at[t] for t in r.terms] for r in here])
        numbers = spark.sparkContext.broadcast(statistics(narrow.select("text"), words, "text"))
        rows = best_rows(narrow, words, held, numbers, top, "doc_id", "text")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = Window.partitionBy("item", F.floor(F.col("task") / TASKS)).orderBy(*order)
        rows = rows.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top).drop("place", "task")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(here)], StructType([StructField("item", LongType()), id_field]))
        rows = rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = [StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]
        return spark.createDataFrame([], StructType([id_field, *empty]))
    return out
