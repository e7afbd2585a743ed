import json
import tempfile
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake.operators import diff
from auditlake.sinks import documents, tables
from auditlake.sources import reports
from tests_support import table

ROWS = [("B", 4, "z\\a.py", 3, 'say "hi" <b>\x01 & ümlaut\n2', "ev\x02"), ("A", 3, "p,q:r.py", 1, "100% sure", ""), ("A", 2, "p.py", 0, "m" * 500, "e"),
        ("C", 1, "p.py", 7, "low", ""), ("D", 0, "p.py", 8, "info", "")]


@pytest.fixture
def found(spark):
    return table(spark, ROWS + [("A", 1, "x", 1, "other", "", "second")]).withColumn("fix", F.when(F.col("rule_id") == "A", "do <it>").otherwise(""))


@pytest.fixture
def stats(spark):
    return spark.createDataFrame([("r", 5, 1, 2), ("second", 1, 0, 0), ("clean", 3, 0, 0), ("quiet", 1, 0, 4)],
                                 "repo string, files_scanned long, files_skipped long, suppressed long")


def written(lines):
    """Documents by repository, read from the written part files in name order."""
    out = tempfile.mkdtemp(prefix="run-")
    documents.write_documents(lines, out)
    return {p.name.split("=")[1]: "".join(f.read_text(encoding="utf-8") for f in sorted(p.glob("part-*.txt")))
            for p in Path(out).glob("repo=*")}


def test_sarif(found, stats):
    docs = written(documents.sarif(found, stats))
    assert set(docs) == {"r", "second", "clean", "quiet"}
    run = json.loads(docs["r"])["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["B", "A", "A", "C", "D"]
    assert [r["level"] for r in run["results"]] == ["error", "error", "warning", "note", "note"]
    first, second, third = run["results"][:3]
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "z/a.py"}, "region": {"startLine": 3}}
    assert "region" not in third["locations"][0]["physicalLocation"] and first["message"]["text"] == ROWS[0][4]
    assert list(first["partialFingerprints"]) == ["auditStable/v1"]
    rules = {r["id"]: r for r in run["tool"]["driver"]["rules"]}
    assert rules["A"]["fullDescription"]["text"] == "100% sure" and rules["A"]["properties"] == {"security-severity": "8.0"}
    assert rules["B"]["help"]["text"] == "T"
    assert json.loads(docs["clean"])["runs"][0]["results"] == []


def test_sarif_is_read_back_unchanged(spark, found, stats):
    docs = written(documents.sarif(found, stats))
    old = reports.load_reports(spark.createDataFrame(list(docs.items()), "repo string, payload string"))
    assert old.count() == 6
    counts = {r.repo: (r.added, r.removed, r.unchanged) for r in diff.diff_reports(old, old).counts.collect()}
    assert counts == {"r": (0, 0, 5), "second": (0, 0, 1)}


def test_json_report(spark, found, stats):
    notes = spark.createDataFrame([("r", "one"), ("r", 'two "x"')], "repo string, note string")
    docs = {k: json.loads(v) for k, v in written(documents.json_report(found, stats, notes)).items()}
    assert docs["r"]["score"] == 100 - 25 - 10 - 3 - 1 and docs["r"]["grade"] == "D"
    assert docs["r"]["counts"] == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 1, "LOW": 1, "INFO": 1}
    assert (docs["r"]["files_scanned"], docs["r"]["files_skipped"], docs["r"]["suppressed"]) == (5, 1, 2)
    assert docs["r"]["notes"] == ["one", 'two "x"'] and len(docs["r"]["findings"]) == 5 and len(docs["r"]["findings"][0]) == 13
    assert docs["clean"]["findings"] == [] and docs["clean"]["score"] == 100


def test_gitlab(found, stats):
    items = json.loads(written(documents.gitlab(found, stats))["r"])
    assert [i["severity"] for i in items] == ["blocker", "major", "minor", "info", "info"]
    assert [i["location"]["lines"]["begin"] for i in items] == [3, 1, 1, 7, 8] and items[0]["location"]["path"] == "z/a.py"


def test_junit(found, stats):
    docs = {k: ET.fromstring(v) for k, v in written(documents.junit(found, stats)).items()}
    root = docs["r"]
    assert (root.get("tests"), root.get("failures")) == ("5", "5")
    assert [(s.get("name"), s.get("tests")) for s in root] == [("auditlake.A", "2"), ("auditlake.B", "1"), ("auditlake.C", "1"), ("auditlake.D", "1")]
    case = root[0][0]
    assert case.get("name") == "p,q:r.py:1" and case[0].text == "fix: do <it>" and case[0].get("message") == "HIGH: 100% sure"
    assert root[0][1].get("name") == "p.py" and len(root[0][1][0].get("message")) == 300
    assert "\x01" not in ET.tostring(root, encoding="unicode")
    assert [s.get("failures") for s in docs["clean"]] == ["0"] and docs["clean"].get("tests") == "1"


def test_annotations(found, stats):
    docs = written(documents.annotations(found, stats))
    lines = docs["r"].splitlines()
    assert lines[0].startswith("::error file=z/a.py,line=3,title=B T::say ") and "%0A2 [ev" in lines[0]
    assert lines[1] == "::error file=p%2Cq%3Ar.py,line=1,title=A T::100%25 sure"
    assert lines[2].startswith("::warning file=p.py,title=A T::") and len(lines[2].split("::")[2]) == 400
    assert docs["clean"].splitlines() == ["::notice::auditlake: no findings"] and "quiet" not in docs


def test_tables(spark, found):
    out = tempfile.mkdtemp(prefix="run-")
    tables.write_findings(found, f"{out}/f")
    assert spark.read.parquet(f"{out}/f").where("repo = 'second'").count() == 1
    tables.write_baseline(found, f"{out}/b")
    tables.write_baseline(found.where("repo = 'r' and rule_id = 'A'"), f"{out}/b")
    kept = spark.read.parquet(f"{out}/b").groupBy("repo").count().collect()
    assert {r["repo"]: r["count"] for r in kept} == {"r": 2, "second": 1}


def load(spark, payload):
    return reports.load_reports(spark.createDataFrame([("r", payload)], "repo string, payload string")).orderBy("pos").collect()


@pytest.mark.parametrize("payload", ["not json", "[]", '"x"', "{}", '{"findings": [{"x": 1}]}', '{"runs": [{"results": [{"level": "error"}, 5]}]}'])
def test_unusable_reports_raise(spark, payload):
    with pytest.raises(Exception, match="not a findings or SARIF report|none parseable"):
        load(spark, payload)


def test_tolerant_items(spark):
    assert load(spark, '{"findings": []}') == [] and load(spark, '{"runs": null}') == []
    row = load(spark, '{"findings": [{"rule_id": "A", "line": "5", "severity": " high "}, {"rule_id": "B", "line": "x"}]}')
    assert [(r.rule_id, r.line, r.severity, r.scanner) for r in row] == [("A", 5, "HIGH", "json")]
    rows = load(spark, '{"runs": [{"results": [{"ruleId": "A", "message": "plain", "level": "weird"}, {"ruleId": "B", "locations": "bad"}, '
                       '{"ruleId": "C", "locations": [], "level": "ERROR"}, {"ruleId": "D", "partialFingerprints": {"otherStable/v1": "x"}}]}]}')
    assert [(r.rule_id, r.severity, r.message) for r in rows] == [("A", "MEDIUM", "plain"), ("C", "HIGH", ""), ("D", "MEDIUM", "")]
    assert rows[2].stable_id == "x"


def test_written_diff(spark, found, stats):
    docs = written(documents.sarif(found, stats))
    new = reports.load_reports(spark.createDataFrame(list(docs.items()), "repo string, payload string"))
    out = tempfile.mkdtemp(prefix="run-")
    tables.write_diff(diff.diff_reports(new.where("rule_id <> 'A'"), new.where("rule_id <> 'B'")), out)
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted((r.status, r.rule_id) for r in rows) == [("added", "A")] * 3 + [("removed", "B")]
    assert spark.read.parquet(f"{out}/counts").where("repo = 'r'").first().unchanged == 2


def test_findings_without_a_message_show_their_title(spark, stats):
    bare = table(spark, [("A", 3, "p", 1, "", ""), ("A", 3, "p", 1, "", "")])
    title = bare.first().title
    sarif = json.loads(written(documents.sarif(bare, stats))["r"])["runs"][0]
    assert [r["message"]["text"] for r in sarif["results"]] == [title, title]
    assert [i["description"] for i in json.loads(written(documents.gitlab(bare, stats))["r"])] == [title, title]
    assert title in bare.select(documents.annotation_text().alias("t")).first().t.split("::")[2]
    assert f'message="HIGH: {title}"' in written(documents.junit(bare, stats))["r"]
