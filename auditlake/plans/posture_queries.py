"""Queries of postures (over a stream of file versions, over levels above and below the repository) and of what is written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditlake.operators import score
from auditlake.options import ScanOptions
from auditlake.plans import corpus
from auditlake.plans import finding_queries
from auditlake.plans import oracle_sql as sql
from auditlake.plans.registry import ORACLES, query
from auditlake.plans.samples import AWS_KEY
from auditlake.schemas import BASELINE
from auditlake.session import shared_dir
from auditlake.sinks import documents, tables, whole
from auditlake.sinks.versions import BaselineVersions
from auditlake.sources.report_pieces import read_report_files
from auditlake.streaming import posture

_BATCHES = 3


@query("streaming_posture", ORACLES["repository_posture"])
def streaming_posture(spark, sf_dir):
    """Every document arrives as a file, every third one in an older version before it and again after it: the posture the stream
    ends with is that of the newest versions."""
    folder = f"{shared_dir(spark)}/auditlake/stream-{uuid.uuid4().hex}"
    number = F.regexp_extract("path", r"\Asrc/d(\d+)/", 1).cast("long")
    newest = corpus.files(spark, sf_dir).withColumn("seq", F.lit(2).cast("long"))
    older = newest.where(number % 3 == 0).withColumns({
        "seq": F.lit(1).cast("long"), "text": F.concat("text", F.lit(f"\nold = '{AWS_KEY}'\n"))})
    for arriving in (older, newest, older.unionByName(newest.where(number % 3 == 0))):
        arriving.write.mode("append").parquet(f"{folder}/files")
    parts = spark.read.parquet(f"{folder}/files")
    stream = (spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", max(1, -(-len(parts.inputFiles()) // _BATCHES)))
              .parquet(f"{folder}/files"))
    posture.start_posture(stream, f"{folder}/changes", f"{folder}/state", ScanOptions(excludes=(), inline_suppressions=False),
                          line_rules=(), file_rules=(), state_rules_on=False).awaitTermination()
    return posture.standing_posture(spark, f"{folder}/changes").select("repo", "score", "findings", "CRITICAL", "HIGH", "grade")


@query("posture_rollup", f"""WITH {finding_queries.DEDUPED},
lv AS (SELECT 't' || (CAST(substr(repo, 2) AS INT) % 3) AS team, repo, split_part(path, '/', 1) AS directory, sev FROM dd),
s AS (SELECT CAST(3 - bit_count(GROUPING(team, repo, directory)) AS INT) AS depth, team, repo, directory,
  sum(CASE sev WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS d, max(sev) AS worst, count(*) AS findings,
  count(*) FILTER (WHERE sev = 4) AS c4, count(*) FILTER (WHERE sev = 3) AS c3, count(*) FILTER (WHERE sev = 2) AS c2,
  count(*) FILTER (WHERE sev = 1) AS c1, count(*) FILTER (WHERE sev = 0) AS c0 FROM lv GROUP BY ROLLUP (team, repo, directory)),
quiet AS (SELECT DISTINCT 't' || (user_id % 20 % 3) AS team, 'u' || (user_id % 20) AS repo FROM events WHERE user_id % 20 >= 10)
SELECT depth, team, repo, directory, {finding_queries._GRADE} FROM (SELECT * FROM s
  UNION ALL SELECT 2, team, repo, NULL, 0, NULL, 0, 0, 0, 0, 0, 0 FROM quiet)""")
def posture_rollup(spark, sf_dir):
    """All, teams, repositories and their first directories; half of the repositories have no findings."""
    team = F.concat(F.lit("t"), (F.substring("repo", 2, 9).cast("int") % 3).cast("string"))
    found = finding_queries._deduped(spark, sf_dir).withColumns({"team": team, "directory": F.substring_index("path", "/", 1)})
    repos = corpus.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo")).withColumn("team", team)
    return score.posture_rollup(found, ["team", "repo", "directory"], repos)


# ---------------------------------------------------------------- what is written and read back

_ENTRY_SQL = f"repo, rule_id, path, line, left(message, 80) AS message80, {sql.stable()} AS stable_id"


@query("written_findings", ORACLES["report_rows"])
def written_findings(spark, sf_dir):
    """The finding rows, written by repository and read back."""
    out = f"{shared_dir(spark)}/auditlake/findings-{uuid.uuid4().hex}"
    rows = finding_queries._deduped(spark, sf_dir)
    tables.write_findings(rows, out)
    back = spark.read.schema(finding_queries.report_rows(spark, sf_dir).schema).parquet(out)
    return back.select(*finding_queries.report_rows(spark, sf_dir).columns)


@query("written_baseline", f"""WITH {finding_queries.DEDUPED} SELECT {_ENTRY_SQL} FROM dd WHERE repo <> 'u1' AND (repo <> 'u2' OR sev > 2)
UNION ALL SELECT 'u1', '', '', 0, '', ''""")
def written_baseline(spark, sf_dir):
    """A baseline of all repositories, then replaced for two of them: one has only severe findings left, the other none."""
    out = f"{shared_dir(spark)}/auditlake/baseline-{uuid.uuid4().hex}"
    found = finding_queries._deduped(spark, sf_dir)
    tables.write_baseline(found, out)
    again = found.where("repo in ('u1', 'u2')")
    tables.write_baseline(again.where("repo = 'u2' and sev > 2"), out, again.select("repo"))
    return spark.read.schema(BASELINE).parquet(out).select(*BASELINE.fieldNames())


@query("baseline_versions_diff", f"""WITH {finding_queries.DEDUPED}, e AS (SELECT {_ENTRY_SQL}, sev, line % 3 AS third FROM dd),
one AS (SELECT * FROM e WHERE third <> 0), two AS (SELECT * FROM e WHERE CASE WHEN repo IN ('u1', 'u3', 'u5') THEN third <> 1 WHEN repo = 'u7' THEN false ELSE third <> 0 END),
n AS (SELECT repo, rule_id, path, line, message80, stable_id, sum(k) AS k FROM (SELECT *, 1 AS k FROM two UNION ALL SELECT *, -1 FROM one) GROUP BY repo, rule_id, path, line, message80, stable_id HAVING sum(k) <> 0)
SELECT repo, rule_id, path, line, message80, stable_id, CASE WHEN k > 0 THEN 'added' ELSE 'removed' END AS status, CAST(abs(k) AS BIGINT) AS times FROM n""")
def baseline_versions_diff(spark, sf_dir):
    """A first version of all repositories, a second of four of them, one of which has become clean."""
    found = finding_queries._deduped(spark, sf_dir)
    store = BaselineVersions(spark, f"{shared_dir(spark)}/auditlake/versions-{uuid.uuid4().hex}")
    first = store.commit(found.where("line % 3 <> 0"))
    again = found.where("repo in ('u1', 'u3', 'u5', 'u7')")
    return store.diff(first, store.commit(again.where("repo <> 'u7' and line % 3 <> 1"), again.select("repo")))


@query("published_reports", f"""WITH {finding_queries.DEDUPED} SELECT repo, {sql.stable()} AS stable_id, rule_id, title, sev, severity, message, path, line,
  evidence, 'json' AS scanner, row_number() OVER (PARTITION BY repo ORDER BY sev DESC, path, line, rule_id, message) - 1 AS pos FROM dd""")
def published_reports(spark, sf_dir):
    """A JSON report per repository, published as one file each and read back in pieces."""
    out = f"{shared_dir(spark)}/auditlake/reports-{uuid.uuid4().hex}"
    found = finding_queries._deduped(spark, sf_dir)
    stats = found.groupBy("repo").agg(*[F.lit(0).cast("long").alias(c) for c in ("files_scanned", "files_skipped", "suppressed")])
    whole.publish_documents(documents.json_report(found, stats), out)
    return read_report_files(spark, out).findings
