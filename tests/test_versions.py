import tempfile
from pathlib import Path

import pytest

from auditlake.sinks.versions import BaselineVersions
from tests_support import table


def found(spark, *rows):
    return table(spark, [(rule, 3, path, 1, "m", "", repo) for repo, rule, path in rows])


def keys(df):
    return sorted((r.repo, r.rule_id, r.path) for r in df.collect())


@pytest.fixture
def store(spark):
    return BaselineVersions(spark, tempfile.mkdtemp(prefix="run-") + "/baseline")


def test_versions_replace_scanned_repositories_only(spark, store):
    assert store.versions() == [] and store.read().count() == 0
    assert store.commit(found(spark, ("a", "R1", "x"), ("a", "R1", "x"), ("b", "R2", "y"))) == 1
    assert store.commit(found(spark, ("a", "R3", "z"))) == 2
    assert store.commit(found(spark).where("false"), found(spark, ("b", "", "")).select("repo")) == 3      # b became clean
    assert keys(store.read(1)) == [("a", "R1", "x"), ("a", "R1", "x"), ("b", "R2", "y")]
    assert keys(store.read(2)) == [("a", "R3", "z"), ("b", "R2", "y")]
    assert keys(store.read()) == [("a", "R3", "z")] and store.versions() == [1, 2, 3]
    assert sorted((r.status, r.repo, r.rule_id, r.times) for r in store.diff(1, 3).collect()) == [
        ("added", "a", "R3", 1), ("removed", "a", "R1", 2), ("removed", "b", "R2", 1)]
    assert store.diff(2, 2).count() == 0
    with pytest.raises(ValueError):
        store.read(9)


def test_what_breaks_off_is_no_version(spark, store, monkeypatch):
    store.commit(found(spark, ("a", "R1", "x")))

    def broken(*args):
        raise OSError("the driver is lost between data and manifest")
    with monkeypatch.context() as patch:
        patch.setattr(store, "_create", broken)
        with pytest.raises(OSError):
            store.commit(found(spark, ("a", "R2", "y")))
    assert keys(store.read()) == [("a", "R1", "x")] and store.versions() == [1]
    Path(store.path, "manifests", "000000000002.json").write_text('{"folders": ["da')        # a manifest cut short
    assert keys(store.read()) == [("a", "R1", "x")] and store.versions() == [1]
    assert store.commit(found(spark, ("a", "R3", "z"))) == 3 and keys(store.read()) == [("a", "R3", "z")]


def test_two_commits_at_once(spark, store, monkeypatch):
    """The second to publish takes the next number and keeps what the first one wrote."""
    other = BaselineVersions(spark, store.path)
    create = store._create

    def late(number, text):
        if not other.versions():
            other.commit(found(spark, ("b", "R2", "y")))
        return create(number, text)
    monkeypatch.setattr(store, "_create", late)
    assert store.commit(found(spark, ("a", "R1", "x"))) == 2
    assert keys(store.read(1)) == [("b", "R2", "y")] and keys(store.read()) == [("a", "R1", "x"), ("b", "R2", "y")]


def test_compaction_keeps_the_entries(spark, store):
    for n in range(3):
        store.commit(found(spark, ("a", f"R{n}", "x"), (f"b{n}", "S", "y")))
    store.commit(found(spark).where("false"), found(spark, ("b1", "", "")).select("repo"))
    before = keys(store.read())
    assert store.compact() == 5 and keys(store.read()) == before and len(store._folders(None)) == 1
    store.commit(found(spark, ("b1", "T", "z")))
    assert keys(store.read()) == sorted([*before, ("b1", "T", "z")])
    assert keys(store.read(4)) == before
