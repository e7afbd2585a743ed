"""URL filters: rules by host and path, and per-host trees of path templates for what no rule covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditlake.llm.common import free_name, small_side
from auditlake.session import materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PARSED = r"(?s)://([^/?#]*)([^?#]*)"
#: Segments that name one item whatever the site: numbers, dates and hexadecimal ids, with or without a file ending.
NUMBER = r"^[0-9][0-9_-]*([.][A-Za-z0-9]{1,5})?$"
HEX = r"^[0-9a-fA-F][0-9a-fA-F-]{15,}([.][A-Za-z0-9]{1,5})?$"
#: A segment is variable if its parent has at least so many children and it has at most this share of the parent's pages.
MIN_CHILDREN, RARE = 8, 0.05
#: Squared z value from which a branch's labels differ from those of its siblings together.
DIFFERENT = 3.84
#: Weight, in labelled pages, of the host's purity in a template's, and of all pages' purity in a host's.
PRIOR = 4.0
MIN_PURITY = 0.5


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARSED, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARSED, 2), F.lit(""))


def rule_for(host: str, path: str, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains if the path starts
    with the rule's path. Rules are settings; they become one expression."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _segments(path: str) -> Column:
    """Non-empty segments with item names generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(NUMBER), "{n}").when(s.rlike(HEX), "{x}").otherwise(s))


def _at_forks(tree: DataFrame) -> DataFrame:
    """``tree`` with ``at`` moved to the next level where paths below a row's branch part, or to the row's end.

    A segment without siblings has no labels to differ from, so the levels passed over are ``*``.
    """
    rest = tree.where("size(template) > at").select("host", F.expr("slice(template, 1, at)").alias("parent"), "template")
    longest = rest.groupBy("host", "parent").agg(F.max(F.struct(F.size("template"), "template")).alias("lead"))
    parts = F.expr("array_position(zip_with(template, slice(lead.template, 1, size(template)), (a, b) -> a <> b), true) - 1")
    forks = (rest.join(longest, ["host", "parent"]).withColumn("parts", parts)
             .groupBy(F.col("host").alias("of"), F.col("parent").alias("below")).agg(F.min(F.when(F.col("parts") >= 0, F.col("parts"))).alias("fork")))
    moved = tree.join(forks, (F.col("host") == F.col("of")) & (F.expr("slice(template, 1, at)") == F.col("below")) & F.expr("size(template) > at"), "left")
    end = F.expr("CAST(IF(size(template) > at, least(coalesce(fork, size(template)), size(template)), at) AS INT)")
    return moved.withColumn("end", end).select("host", "segments", "n", "good", "bad", F.col("end").alias("at"), F.expr(
        "concat(slice(template, 1, at), array_repeat('*', end - at), slice(template, end + 1, size(template)))").alias("template"))


def templates(pages: DataFrame) -> DataFrame:
    """Template of every distinct (host, segments): host, segments, template, purity, reject.

    ``pages`` has host, path, verdict (label ``allow`` or ``block``, or null). It is first reduced to its distinct item-free
    paths with counts, on the map side. Then the trees of all hosts are generalised level by level. Below each parent,
    segments with many siblings and few pages become ``*``; after that, branches whose labels do not differ
    significantly from those of their siblings together are merged into one ``*`` branch. Every segment is judged, however
    deep; levels without a fork are passed over together, so a round is needed only where paths below a branch part.
    Each round is a few aggregates keyed by host and parent and is written, so neither a host with a third of all pages nor a
    parent with millions of children is held anywhere. A template's purity is its share of allowed among labelled pages, smoothed towards its
    host's, which is smoothed towards that of all pages; below MIN_PURITY it is rejected.
    """
    tree = pages.groupBy("host", _segments("path").alias("segments")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    tree = materialize(_at_forks(tree.withColumn("template", F.col("segments")).withColumn("at", F.lit(0))), "paths")
    while tree.where("size(template) > at").limit(1).count():
        parent, name = F.expr("slice(template, 1, at)"), F.expr("get(template, at)")
        here = tree.where("size(template) > at").select("host", parent.alias("parent"), name.alias("name"), "n", "good", "bad")
        named = here.groupBy("host", "parent", "name").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        sizes = named.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("of_n"))
        named = named.join(sizes, ["host", "parent"])
        variable = (F.col("children") >= MIN_CHILDREN) & (F.col("n") <= F.lit(RARE) * F.col("of_n"))
        named = materialize(named.withColumn("branch", F.when(variable, "*").otherwise(F.col("name"))), "branches")
        branches = named.groupBy("host", "parent", "branch").agg(*[F.sum(c).cast("double").alias(c) for c in ("good", "bad")])
        totals = named.groupBy("host", "parent").agg(*[F.sum(c).cast("double").alias("of_" + c) for c in ("good", "bad")])
        mine, rest = F.col("good") + F.col("bad"), F.col("of_good") - F.col("good") + F.col("of_bad") - F.col("bad")
        share, other = F.try_divide(F.col("good"), mine), F.try_divide(F.col("of_good") - F.col("good"), rest)
        pooled = F.try_divide(F.col("of_good"), F.col("of_good") + F.col("of_bad"))
        errors = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), mine) + F.try_divide(F.lit(1.0), rest))
        differs = (share - other) * (share - other) > F.lit(DIFFERENT) * errors  # null, and so no branch of its own, without labels
        branches = branches.join(totals, ["host", "parent"]).select("host", "parent", "branch", F.coalesce(differs, F.lit(False)).alias("own"))
        renamed = named.join(branches, ["host", "parent", "branch"]).select(
            "host", "parent", "name", F.when(F.col("own"), F.col("branch")).otherwise("*").alias("now")).where("name <> now")
        keyed = tree.withColumn("parent", parent).withColumn("name", name)
        split = keyed.join(renamed, ["host", "parent", "name"], "left").select(
            "host", "segments", "n", "good", "bad", F.expr("IF(name IS NULL, at, at + 1)").alias("at"),
            F.when(F.col("now").isNull(), F.col("template")).otherwise(
                F.expr("concat(parent, array(now), slice(template, at + 2, size(template)))")).alias("template"))
        tree = materialize(_at_forks(materialize(split, "split")), "tree")
    counts = tree.groupBy("host", "template").agg(*[F.sum(c).cast("double").alias(c) for c in ("good", "bad")])
    hosts = counts.groupBy(F.col("host").alias("of")).agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    everywhere = ((good or 0.0) + 1.0) / ((good or 0.0) + (bad or 0.0) + 2.0)
    of_host = (F.col("host_good") + PRIOR * F.lit(everywhere)) / (F.col("host_good") + F.col("host_bad") + PRIOR)
    purity = (F.col("good") + PRIOR * of_host) / (F.col("good") + F.col("bad") + PRIOR)
    judged = counts.join(hosts, F.col("host") == F.col("of")).select("host", "template", purity.alias("purity"))
    return tree.select("host", "segments", "template").join(judged, ["host", "template"]).withColumn("reject", F.col("purity") < MIN_PURITY)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """``pages`` and for each row: host, path, rule, verdict (allow or block), template, purity.

    The verdict is that of the longest rule that fits; pages without a rule get the method's, block for the templates that
    :func:`templates` rejects. Labels of the trees are the rules' verdicts and, if given, ``labels`` (host, path, verdict:
    one row per labelled pair). Null urls and those without ``://`` have empty host and path and are judged like any other
    template. Repeated rows are pages of their own. New columns get underscores in front where ``pages`` has their names.
    An empty table gives no rows.
    """
    name = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "template", "purity", "reject", "segments")}
    marked = pages.withColumn(name["host"], host(url)).withColumn(name["path"], path(url))
    rule, verdict = rule_for(name["host"], name["path"], rules)
    marked = marked.withColumn(name["rule"], rule).withColumn(name["verdict"], verdict)
    narrow = marked.select(*[F.col(name[c]).alias(c) for c in ("host", "path", "verdict")])
    if labels is not None:
        narrow = narrow.unionByName(labels.select("host", "path", "verdict"))
    found = materialize(templates(narrow), "templates").withColumnsRenamed({c: name[c] for c in ("template", "purity", "reject")})
    found = small_side(found.select(F.col("host").alias("of"), F.col("segments").alias("under"), name["template"], name["purity"], name["reject"]),
                       F.length("of") + F.length(F.array_join("under", "/")) + F.length(F.array_join(name["template"], "/")) + 120)
    marked = marked.withColumn(name["segments"], _segments(name["path"]))
    joined = marked.join(found, (F.col(name["host"]) == F.col("of")) & (F.col(name["segments"]) == F.col("under")), "left")
    method = F.when(F.col(name["reject"]), "block").otherwise("allow")
    return joined.select(*pages.columns, name["host"], name["path"], name["rule"], F.coalesce(name["verdict"], method).alias(name["verdict"]),
                         F.concat(F.lit("/"), F.array_join(name["template"], "/")).alias(name["template"]), name["purity"])


def oracle() -> str:
    """The same in DuckDB SQL: each level of the tree is a round of a recursive table."""
    cases = "".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{{}}' "
                    for _, t in sorted(RULES, key=lambda r: -len(r[1])) for h, _, p in [t.partition("/")])
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule, verdict = cases.format(*[r[1] for r in ordered]), cases.format(*[r[0] for r in ordered])
    typed = (f"CASE WHEN regexp_matches(s, '{NUMBER}') THEN '{{n}}' WHEN regexp_matches(s, '{HEX}') THEN '{{x}}' ELSE s END")
    return f"""WITH RECURSIVE p0 AS (SELECT page_id, coalesce(regexp_extract(url, '{PARSED}', 1), '') AS raw, coalesce(regexp_extract(url, '{PARSED}', 2), '') AS path FROM pages),
p1 AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p0),
p3 AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS said, [{typed} FOR s IN string_split(path, '/') IF s <> ''] AS segments FROM p1),
deep AS (SELECT max(len(segments)) AS levels FROM p3),
t AS (
SELECT 0 AS i, host, segments, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS good, count(*) FILTER (WHERE said = 'block') AS bad,
  segments AS template FROM p3 GROUP BY host, segments
UNION ALL SELECT i + 1, host, segments, n, good, bad, CASE WHEN now IS NULL THEN template
  ELSE list_concat(list_concat(template[1:i], [now]), template[i + 2:]) END AS template FROM (
SELECT *, CASE WHEN len(template) <= i THEN NULL
  WHEN bgood + bbad > 0 AND ag - bgood + ab - bbad > 0 AND
  (bgood / (bgood + bbad) - (ag - bgood) / (ag - bgood + ab - bbad)) * (bgood / (bgood + bbad) - (ag - bgood) / (ag - bgood + ab - bbad))
  > {DIFFERENT}::DOUBLE * (ag / (ag + ab) * (1 - ag / (ag + ab)) * (1 / (bgood + bbad) + 1 / (ag - bgood + ab - bbad))) THEN branch ELSE '*' END AS now
FROM (SELECT *, (sum(good) OVER b)::DOUBLE AS bgood, (sum(bad) OVER b)::DOUBLE AS bbad, (sum(good) OVER w)::DOUBLE AS ag, (sum(bad) OVER w)::DOUBLE AS ab
FROM (SELECT *, CASE WHEN children >= {MIN_CHILDREN} AND mine <= {RARE}::DOUBLE * whole THEN '*' ELSE name END AS branch
FROM (SELECT *, max(nth) OVER w AS children, sum(n) OVER w AS whole, sum(n) OVER v AS mine
FROM (SELECT *, dense_rank() OVER (PARTITION BY host, parent ORDER BY name) AS nth
FROM (SELECT *, CASE WHEN len(template) > i THEN template[1:i] END AS parent, CASE WHEN len(template) > i THEN template[i + 1] END AS name
FROM t JOIN deep ON i < levels))
WINDOW w AS (PARTITION BY host, parent), v AS (PARTITION BY host, parent, name)))
WINDOW w AS (PARTITION BY host, parent), b AS (PARTITION BY host, parent, branch)))),
z AS (SELECT t.* FROM t JOIN deep ON i = levels),
c AS (SELECT host, template, sum(good)::DOUBLE AS good, sum(bad)::DOUBLE AS bad FROM z GROUP BY ALL),
g AS (SELECT *, sum(good) OVER w AS hg, sum(bad) OVER w AS hb, (sum(good) OVER () + 1.0::DOUBLE) / (sum(good) OVER () + sum(bad) OVER () + 2.0::DOUBLE) AS prior
  FROM c WINDOW w AS (PARTITION BY host)),
j AS (SELECT host, template, (good + {PRIOR}::DOUBLE * ((hg + {PRIOR}::DOUBLE * prior) / (hg + hb + {PRIOR}::DOUBLE))) / (good + bad + {PRIOR}::DOUBLE) AS purity FROM g)
SELECT page_id, p3.host, path, rule, coalesce(said, CASE WHEN purity < {MIN_PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(j.template, '/') AS template
FROM p3 JOIN z ON p3.host = z.host AND p3.segments = z.segments JOIN j ON j.host = z.host AND j.template = z.template"""
