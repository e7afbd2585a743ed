"""Session settings and the shared place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Repository files are wide rows: keep Arrow batches small in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Text partitions are CPU-bound on regular expressions: prefer many small splits.
    "spark.sql.files.maxPartitionBytes": "16m",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Every executor has to see it, so a cluster must name one. Only a session whose driver is its
    sole process (master ``local`` or ``local[...]``, as in tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    created = tempfile.mkdtemp(prefix="auditlake-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive pass feeds several consumers, so that neither a second
    consumer nor a lost executor repeats the pass.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/auditlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
