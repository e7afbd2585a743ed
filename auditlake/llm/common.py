"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A join side measured to be at most this large may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 48_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session told to hand whole texts to Python a few hundred rows at a time, unless it has a setting of
    its own: at Spark's default of 10,000 rows, batches of texts are most of a worker's memory."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key, "10000") == "10000":
        conf.set(key, "500")
    return df


class Sent:
    """A value of this package's classes, broadcast as bytes that workers without the package can load, once per task."""

    def __init__(self, spark: SparkSession, value):
        self._bytes, self._loaded = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    @property
    def value(self):
        if not self._loaded:
            self._loaded.append(cloudpickle.loads(self._bytes.value))
        return self._loaded[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first variant of it that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def small_side(df: DataFrame, row_bytes) -> DataFrame:
    """Mark a written table for broadcast if its measured size allows it; else leave the choice to Spark.

    ``row_bytes`` is an expression for the bytes of a row. Both choices give the same rows.
    """
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about ``limit`` bytes; one longer text is a slice alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            total += size or 0
            if total > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, size or 0
        if start < len(sizes):
            yield batch.slice(start)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): every linked node as ``node`` with its smallest ``root``.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and
    beyond"): each step groups by node with a map-side minimum and joins that minimum back, so a hub costs
    no single task all its links, and every round is written to the shared folder. Empty links give no rows;
    repeated links and links of a node to itself are ignored.
    """
    def pairs(df):
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(pairs(links), "links")
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(pairs(large), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"),
                                              F.col("m").alias("b"))
        edges = materialize(pairs(small), "small-star")
        before, seen = seen, mark(edges)
        if before == seen:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
