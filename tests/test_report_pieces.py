import json
import random
import tempfile
from pathlib import Path

import pytest

from auditlake.sources import report_pieces, reports

NASTY = ['}', '{"', 'a}b"}]', "\\", '\\"}', "[[{,", "ü}\n", ""]
DOCS = {
    "plain": {"findings": [{"rule_id": "A", "message": m, "line": i, "deep": [[{"findings": [{"x": m}]}]]} for i, m in enumerate(NASTY)]},
    "sarif": {"$schema": "}", "version": "2.1.0", "runs": [
        {"tool": {"driver": {"rules": [{"id": "}", "results": [1]}]}}, "results": [
            {"ruleId": f"S{i}", "message": {"text": m}, "properties": {"results": [1, 2]}} for i, m in enumerate(NASTY)]},
        {"results": None}, 3, [[5], {"results": [6]}], {"results": []}, {"results": [{"ruleId": "last"}, 7, "x,]", None, True]}]},
    "both": {"findings": [{"rule_id": "hidden"}], "runs": [{"results": [{"ruleId": "seen"}]}]},
    "empty": {"findings": []}, "no_runs": {"runs": None}, "odd_runs": {"runs": {"results": [{"ruleId": "x"}]}},
    "nested": {"x": {"findings": [{"rule_id": "A"}]}}, "list": [{"findings": [1]}], "text": "findings", "number": 5,
    "unusable": {"findings": [{"x": 1}, 3]}, "sarif_unusable": {"runs": [{"results": [{"level": "error"}, 5]}]},
}
TEXTS = {
    "truncated": '{"findings": []', "truncated_item": '{"findings": [{"rule_id": "A"}', "open_string": '{"findings": [], "x": "}',
    "crossed": '{"findings": [}]', "bad_item": '{"findings": [{"rule_id": "A"}, {"rule_id" "B"}]}',
    "comma": '{"findings": [{"rule_id": "A"},]}', "blank": "", "spaces": "  \n", "after": '{"findings": [ {"rule_id": "A"} ]}\n\n',
    "wide": '\n{ "findings" :\n[\n\n]\n }', "escaped_key": '{"\\u0066indings": [{"rule_id": "A"}]}', "only_brace": "}", "brackets": "]]",
}


def texts():
    return {**{k: json.dumps(v, ensure_ascii=False) for k, v in DOCS.items()},
            **{k + "_spaced": json.dumps(v, indent=3) for k, v in DOCS.items()}, **TEXTS}


def put(docs):
    out = tempfile.mkdtemp(prefix="run-")
    for name, text in docs.items():
        Path(out, f"{name}.json").write_text(text, encoding="utf-8")
    return out


def same_as_whole(spark, docs, **options):
    got = report_pieces.read_report_files(spark, put(docs), strict=False, **options)
    whole = spark.createDataFrame(list(docs.items()), "repo string, payload string")
    wanted = sorted(map(tuple, reports.load_reports(whole, strict=False).collect()))
    assert sorted(map(tuple, got.findings.collect())) == wanted
    assert sorted(map(tuple, got.errors.collect())) == sorted(map(tuple, reports.report_errors(whole).collect()))
    return len(wanted)


@pytest.fixture
def blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield of
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_whole_files(spark):
    assert same_as_whole(spark, texts()) > 30


@pytest.mark.parametrize("size", [101])
def test_files_in_blocks(spark, blocks, size):
    few = {k: v for k, v in texts().items() if k in ("plain", "sarif", "sarif_spaced", "both", "bad_item", "truncated", "after", "wide")}
    blocks(size)
    assert same_as_whole(spark, few) > 20


def test_states_by_shuffle(spark, blocks):
    few = {k: v for k, v in texts().items() if k in ("plain", "sarif", "truncated")}
    blocks(60)
    assert same_as_whole(spark, few, broadcast_blocks=0) > 10


def test_a_second_value_is_no_report(spark):
    got = report_pieces.read_report_files(spark, put({"two": '{"findings": []}{"findings": [{"rule_id": "A"}]}'}), strict=False)
    assert got.findings.count() == 0 and got.errors.first().error == report_pieces.NO_REPORT


def test_strict(spark):
    with pytest.raises(ValueError, match="not a findings or SARIF report: bad"):
        report_pieces.read_report_files(spark, put({"bad": "no", "good": '{"findings": []}'}))
    with pytest.raises(ValueError, match="2 findings but none parseable: u"):
        report_pieces.read_report_files(spark, put({"u": texts()["unusable"]}))


def test_a_large_file_in_many_tasks(spark, blocks):
    """One file of 30 MB in blocks of 2 MB; an item of 5 MB runs over several."""
    rng = random.Random(5)
    items = [{"rule_id": f"R{i % 50}", "path": f"p{i}", "line": i, "message": rng.choice(NASTY) * 20, "severity": "high"} for i in range(150_000)]
    items[70_000]["message"] = "}{" * 2_500_000
    folder = put({"big": json.dumps({"findings": items})})
    blocks(2 << 20)
    got = report_pieces.read_report_files(spark, folder).findings
    kept = got.selectExpr("pos", "line", "path", "length(message) AS n").toPandas()
    assert len(kept) == 150_000 and (kept["pos"] == kept["line"]).all() and (kept["path"] == "p" + kept["pos"].astype(str)).all()
    assert kept["n"].sum() == sum(len(i["message"]) for i in items)
    assert report_pieces._pieces(spark, [folder]).rdd.getNumPartitions() > 8


def test_walk_in_any_state():
    """A block summed up for both cases is right for the case that holds, wherever a text is cut behind a brace."""
    text = texts()["sarif"]
    cuts = [i + 1 for i, c in enumerate(text) if c == "}"]
    for cut in cuts:
        head, tail = report_pieces.Walk(), None
        list(head.tokens(text[:cut]))
        tail = report_pieces.Walk(quoted=head.quoted)
        list(tail.tokens(text[cut:]))
        stack = list(head.stack)
        for mark in tail.closed:
            assert stack.pop()[0] == report_pieces.OPENED_BY[mark]
        assert stack + tail.stack == [] and not tail.quoted and not head.broken and not tail.broken
