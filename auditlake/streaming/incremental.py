"""Incremental scans: arriving files are scanned once, per micro-batch.

All per-file rules work inside a file's row, so the file pass is stateless and runs on a
streaming files table unchanged. What compares with earlier results (baseline,
suppressions, deduplication) runs per micro-batch against tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.operators.file_scan import scan_files
from auditlake.operators.findings import dedupe
from auditlake.operators.suppress import apply_suppressions, subtract_baseline
from auditlake.options import ScanOptions
from auditlake.schemas import FILES
from auditlake.sources.files import discover


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet parts of a files table as a stream."""
    return (spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def start_scan(files: DataFrame, out: str, checkpoint: str, options: ScanOptions | None = None,
               baseline: DataFrame | None = None, suppressions: DataFrame | None = None):
    """Append the new findings of each micro-batch to ``out/batch=…``; a retried batch overwrites itself."""
    options = options or ScanOptions()

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        findings = dedupe(scan_files(discover(batch, options), options).where("not ignored"))
        if suppressions is not None:
            findings = apply_suppressions(findings, suppressions)
        if baseline is not None:
            findings = subtract_baseline(findings, baseline)
        findings.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (files.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
