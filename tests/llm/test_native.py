import random
import re

import pytest

from auditlake.llm import mixing, url_filter
from auditlake.llm.line_dedup import drop_boilerplate
from auditlake.llm.mixing import mix, mix_sizes, ranked_weights, split_quotas, targets

DOCS = "doc_id long, text string, source string"


def plain_lines(rows, ratio, least):
    pages = [(s, (t or "").split("\n") if t is not None else []) for _, t, s in rows]
    total, seen = {}, {}
    for s, lines in pages:
        total[s] = total.get(s, 0) + 1
        for body in {x.strip(" \t\r") for x in lines} - {""}:
            seen[s, body] = seen.get((s, body), 0) + 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in drop)) for d, t, s in rows]


def test_lines_against_brute_force(spark):
    rnd = random.Random(1)
    pool = [f"line {i}" for i in range(60)] + ["menu", " menu\t", "menu\r", "", "  ", "ünï"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 9))), rnd.choice(["a", "b", None])) for i in range(200)]
    rows += [(300, None, "a"), (301, "", None), (7, "menu\nmenu", "b"), (7, "line 3", "b"), (None, "menu", "a"), (None, "menu", "a"),
             (400, "x" * 200_000 + "\nmenu", "a"), (401, "menu", "tiny")]
    df = spark.createDataFrame(rows, DOCS)
    clash = df.selectExpr("*", "1 AS keys", "2 AS key", "3 AS was", "length(text) AS n_chars")
    for ratio, least in ((0.1, 5), (0.02, 3)):
        want = plain_lines(rows, ratio, least)
        out = drop_boilerplate(clash, ratio=ratio, min_pages=least, lines="n_lines", dropped="n_dropped")
        assert out.columns == [*clash.columns, "n_lines", "n_dropped"]
        got = out.collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t in want)
        assert {r.n_chars for r in got if r.doc_id == 400} == {200_000}
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_targets_stop_at_three_times_and_share_the_rest(spark):
    df = spark.createDataFrame([("a", 100), ("b", 5), (None, 1), ("c", 300), ("é", 0)], "source string, source_size long")
    given = {r.source: r.weight for r in ranked_weights(df).collect()}
    assert given == {"a": 1, "b": 2, "c": 3, "é": 1, None: 2}
    got = {r.source: r.target for r in targets(df.join(ranked_weights(df), df.source.eqNullSafe(ranked_weights(df).source)).drop(ranked_weights(df).source)).collect()}
    left = 406 - 15 - 3
    assert got == pytest.approx({"b": 15, None: 3, "é": 0, "a": left / 4, "c": 3 * left / 4})


def test_splitting_tree_keeps_quotas_and_halves(spark):
    df = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5000), (5, 1)], "rank int, quota long")
    for seed in range(3):
        rows = split_quotas(df, 8, seed).collect()
        for rank, quota in ((1, 1000), (2, 37), (3, 0), (4, 5000), (5, 1)):
            assert sum(r.quota for r in rows if r.rank == rank) == quota and all(r.quota >= 0 for r in rows)
        sums = [sum(r.quota for r in rows if r.shard == k) for k in range(8)]
        assert max(sums) - min(sums) <= 3


def test_draws_are_hypergeometric(spark):
    expr = mixing._draw("pop", "marked", "draws", "dice")
    df = spark.range(20_000).selectExpr("30L AS pop", "12L AS marked", "10L AS draws", "(id + 0.5D) / 20000 AS dice").selectExpr(f"{expr} AS x")
    from math import comb
    got = {r.x: r["count"] / 20_000 for r in df.groupBy("x").count().collect()}
    for x in range(0, 11):
        assert got.get(x, 0) == pytest.approx(comb(12, x) * comb(18, 10 - x) / comb(30, 10), abs=2e-4)


def test_places_are_a_permutation(spark):
    df = spark.range(1000).selectExpr("id AS b", "0L AS e", "3 AS rank", "1000L AS blocks", "11 AS seed")
    places = [r[0] for r in df.select(mixing.F.expr(mixing._place("b", "e", "rank", "blocks", "seed"))).collect()]
    assert sorted(places) == list(range(1000)) and places != list(range(1000))


@pytest.fixture
def mixed_docs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([" ", "\n"]).join(["wörd"] * rnd.choice([0, 1, 5, 50, 400])), rnd.choice(["a"] * 6 + ["b", "c", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "d"), (5, "again here", "b"), (5, "again here", "b"), (None, "x y", "a"), (1002, "w " * 30_000, "c")]
    return spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", size int")


def test_mix_meets_its_targets(mixed_docs):
    rows = mix_sizes(mixed_docs).collect()
    assert len(rows) == mixed_docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    texts = {(r.doc_id, r.source): r.text for r in mixed_docs.collect()}
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(1, size / 128)
    assert sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts.values()) + 2
    again = mix_sizes(mixed_docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_texts_have_the_planned_words(mixed_docs):
    out = mix(mixed_docs, shards=4)
    assert out.columns == mixed_docs.columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").split())
    want = {}
    for r in mix_sizes(mixed_docs, shards=4).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}


def test_shards_take_their_quota_of_blocks(mixed_docs):
    from auditlake.llm.mixing import plan, word_count
    pieces = plan(mixed_docs.withColumn("size", word_count()), shards=4).selectExpr("source", "inline(pieces)").collect()
    blocks = [len({(p.source, p.turn) for p in pieces if p.shard == k}) for k in range(4)]
    assert max(blocks) - min(blocks) <= 2
    where = {}
    for p in pieces:
        assert where.setdefault((p.source, p.turn), p.shard) == p.shard


def test_empty_mix(mixed_docs):
    assert mix_sizes(mixed_docs.limit(0)).count() == 0 and mix(mixed_docs.limit(0)).count() == 0
    assert mix_sizes(mixed_docs.where("text = ''")).where("taken > 0").count() == 0


URLS = [(1, "https://a.example.org/es/4"), (2, "http://EXAMPLE.org/en/12?x"), (3, "x://org"), (4, "x://b.com/fr/"), (5, None), (6, "no scheme"),
        (7, "http://notorg/es/"), (8, "u://a.de.com/de/1#://b.org/"), (9, "x://org/a"), (9, "x://org/a"), (10, "ü://É.net/ß?/"), (11, "://")]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'k' AS host", "1 AS segments")
    out = url_filter.judge_urls(df)
    assert out.columns == ["page_id", "url", "host", "segments", "_host", "path", "rule", "verdict", "template", "purity"]
    got = {r.page_id: (r._host, r.path, r.rule) for r in out.collect()}
    assert got == {1: ("a.example.org", "/es/4", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("org", "", None),
                   4: ("b.com", "/fr/", "com/fr/"), 5: ("", "", None), 6: ("", "", None), 7: ("notorg", "/es/", None),
                   8: ("a.de.com", "/de/1", "com/de/"), 9: ("org", "/a", "org/"), 10: ("É.net", "/ß", None), 11: ("", "", None)}
    assert out.count() == len(URLS) and url_filter.judge_urls(df.limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    pages = [("h", f"/news/{w}-{i}/x", "allow") for i in range(40) for w in ("p",)] + [("h", f"/spam/{i}", "block") for i in range(40)]
    pages += [("h", f"/spam/z{i}", None) for i in range(30)] + [("h", f"/misc/{i}.html", None) for i in range(3)] + [("other", "/a/b/c/d/e/f/g/h/i", None)]
    df = spark.createDataFrame(pages, "host string, path string, verdict string")
    got = {(r.host, "/".join(r.segments)): ("/".join(r.template), r.reject) for r in url_filter.templates(df).collect()}
    assert got["h", "news/p-3/x"] == ("news/*/*", False) or got["h", "news/p-3/x"][1] is False
    assert got["h", "spam/{n}"][0].startswith("spam/") and got["h", "spam/{n}"][1] is True
    assert got["h", "spam/z3"][1] is True
    assert got["h", "misc/{n}"][0].startswith("*/")
    assert got["other", "a/b/c/d/e/f/g/h/i"] == ("*/*/*/*/*/*/*/*/*", False)


def test_branches_that_part_at_the_eighth_segment(spark):
    lead = "/a/b/c/d/e/f/g"
    pages = [("h", f"{lead}/good/p{i}/x", "allow") for i in range(40)] + [("h", f"{lead}/bad/p{i}/x", "block") for i in range(40)]
    pages += [("h", f"{lead}/good/new", None), ("h", f"{lead}/bad/new", None), ("h", lead, None), ("h", "/a/b", None)]
    got = {"/".join(r.segments): ("/".join(r.template), r.reject) for r in url_filter.templates(
        spark.createDataFrame(pages, "host string, path string, verdict string")).collect()}
    assert got[f"{lead[1:]}/good/new"] == ("*/*/*/*/*/*/*/good/*", False) and got[f"{lead[1:]}/bad/new"] == ("*/*/*/*/*/*/*/bad/*", False)
    assert got[f"{lead[1:]}/good/p3/x"] == ("*/*/*/*/*/*/*/good/*/*", False) and got[f"{lead[1:]}/bad/p3/x"] == ("*/*/*/*/*/*/*/bad/*/*", True)
    assert got[lead[1:]][0] == "*/*/*/*/*/*/*" and got["a/b"][0] == "*/*"


def test_very_long_urls_take_rounds_by_forks(spark, monkeypatch):
    written = []
    kept = url_filter.materialize
    monkeypatch.setattr(url_filter, "materialize", lambda df, name: written.append(name) or kept(df, name))
    long = "/s" * 3000
    rows = [(1, f"x://h{long}/a"), (2, f"x://h{long}/b"), (3, f"x://h{long}"), (4, "x://h/s/s"), (5, "x://other" + "/é" * 2000 + "?" + "q" * 100_000)]
    out = {r.page_id: r.template for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[1] == out[2] == "/*" * 3001 and out[3] == "/*" * 3000 and out[4] == "/*/*" and out[5] == "/*" * 2000
    assert written.count("tree") == 1


def test_urls_against_sql_on_random_trees(spark):
    """Deep trees on hosts with both verdicts, rows that end inside others' paths, repeats and nulls."""
    import duckdb
    rnd = random.Random(8)
    rows = [(None, None), (0, None), (0, "x://"), (0, "none")]
    for i in range(1500):
        host = rnd.choice(["example.org", "sub.example.org", "b.com", "plain.net"])
        first = rnd.choice(["es", "en", "fr", "de", "12"])
        parts = [rnd.choice("abc") if rnd.random() < 0.9 else f"v{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 11))]
        rows.append((i, f"http://{host}/{first}/{'/'.join(parts)}"))
    rows += rows[10:40]
    names = ["host", "path", "rule", "verdict", "template"]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [tuple(r) for r in url_filter.judge_urls(df).select("page_id", *names).collect()]
    base = duckdb.connect()
    base.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    want = base.sql(f"SELECT page_id, {', '.join(names)} FROM ({url_filter.oracle()})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({r[-1] for r in got}) > 20


def test_one_shard_is_written_by_many_tasks(spark, mixed_docs):
    """A shard's rows are dealt by runs of its shuffle, so the number of tasks does not follow the number of shards."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mix(mixed_docs, shards=1).withColumn("task", mixing.F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    other = mix(mixed_docs, shards=4).collect()
    assert len({r.task for r in rows}) > 1
    assert sorted({(r.doc_id, r.source) for r in rows}, key=repr) == sorted({(r.doc_id, r.source) for r in other}, key=repr)
