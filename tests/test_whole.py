import json
import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake.sinks import documents, whole
from auditlake.sources import reports
from tests_support import table


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="run-"), "out")


def beside(target):
    return [p.name for p in Path(target).parent.iterdir()]


def test_a_document_per_repository(spark):
    found = table(spark, [("A", 3, f"p{i}.py", i, f"ü {i}", "e", repo) for i in range(400) for repo in ("big", "o/ther", "..", "x" * 300)])
    target = fresh()
    whole.publish_documents(documents.sarif(found, found), "file://" + target)
    docs = {p.name: json.loads(p.read_bytes()) for p in Path(target).iterdir()}
    assert set(docs) == {whole.file_name(r, "json") for r in ("big", "o/ther", "..", "x" * 300)} and beside(target) == ["out"]
    for doc in docs.values():
        assert [r["message"]["text"] for r in doc["runs"][0]["results"]] == [
            f"ü {i}" for i in sorted(range(400), key=lambda i: f"p{i}.py")]
    texts = spark.createDataFrame([("big", (Path(target) / "big.json").read_text())], "repo string, payload string")
    assert reports.load_reports(texts).count() == 400


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "repo string, section int, key int, text string")


def test_many_ranges_fill_one_file(spark):
    lines = lines_of(spark, [("r", 0, i, "é" * (i % 7)) for i in range(5000)] + [(None, 0, 0, None), ("", 0, 1, "e")])
    target = fresh()
    whole.publish_documents(lines, target, "txt")
    assert (Path(target) / "r.txt").read_text() == "".join("é" * (i % 7) + "\n" for i in range(5000))
    assert (Path(target) / "%.txt").read_text() == "\n" and (Path(target) / "%%.txt").read_text() == "e\n"


def test_a_failing_task_leaves_nothing(spark):
    # the line that fails is read by the writing tasks alone
    lines = lines_of(spark, [("r", 0, i, "x") for i in range(50)])
    target = fresh()
    kept = whole.DocumentsWriter.write

    def broken(self, iterator):
        kept(self, iterator)
        raise OSError("disk gone")
    whole.DocumentsWriter.write = broken
    try:
        with pytest.raises(Exception, match="disk gone"):
            whole.publish_documents(lines, target)
    finally:
        whole.DocumentsWriter.write = kept
    assert beside(target) == []


def test_missing_bytes_are_not_published(spark):
    target = fresh()
    writer = whole.DocumentsWriter(target, 5)
    message = writer.write(iter([{"file": "a", "at": 0, "text": "abc"}]))
    with pytest.raises(OSError, match="4 of 5"):
        writer.commit([message])
    assert beside(target) == []


def test_written_again_at_the_same_places(spark):
    target = fresh()
    writer = whole.DocumentsWriter(target, 8)
    rows = [{"file": "a", "at": 0, "text": "abc"}]
    late = [{"file": "a", "at": 4, "text": "xyz"}]
    writer.write(iter(late))
    writer.write(iter(rows))
    messages = [writer.write(iter(rows)), writer.write(iter(late))]
    writer.commit(messages)
    assert (Path(target) / "a").read_text() == "abc\nxyz\n"


def test_no_lines_existing_targets_and_other_file_systems(spark):
    target = fresh()
    whole.publish_documents(lines_of(spark, []), target)
    assert os.listdir(target) == []
    with pytest.raises(FileExistsError):
        whole.publish_documents(lines_of(spark, []), target)
    with pytest.raises(ValueError, match="s3"):
        whole.publish_documents(lines_of(spark, []), "s3://bucket/x")
