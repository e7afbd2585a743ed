"""Multiplicity-aware difference between two snapshots of reports.

Per stable id, findings pair first by exact key, then by position; the rest was added or
removed. Positions are ranked in blocks (count per block, prefix sums over blocks, rank
inside a block), so even one key that fills a third of a report is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.findings import report_order
from auditlake.session import materialize

RANK_BLOCK = 100_000
EXACT = ["repo", "stable_id", "rule_id", "path", "line", "message"]
GROUP = ["repo", "stable_id"]


@dataclass
class ReportDiff:
    """``rows``: added and removed findings with ``status``; ``counts``: totals per repository."""

    rows: DataFrame
    counts: DataFrame

    @property
    def added(self) -> DataFrame:
        return self.rows.where("status = 'added'").drop("status")

    @property
    def removed(self) -> DataFrame:
        return self.rows.where("status = 'removed'").drop("status")


def ranked(df: DataFrame, keys: list[str], position: str, out: str, block: int = RANK_BLOCK,
           weight: Column | None = None) -> DataFrame:
    """Add the running total of ``weight`` by ``position`` within ``keys``; by default the rank.

    ``position`` is a non-negative ordinal, unique within ``keys``. Totals per block are
    summed first, so that a task orders at most ``block`` positions of a key.
    """
    weight = F.lit(1) if weight is None else weight
    blocked = df.withColumns({"_block": F.floor(F.col(position) / block), "_weight": weight})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocked.groupBy(*keys, "_block").agg(F.sum("_weight").alias("_total"))
               .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total"))
    inside = (Window.partitionBy(*keys, "_block").orderBy(position)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (blocked.join(offsets, [*keys, "_block"])
            .withColumn(out, F.col("_offset") + F.sum("_weight").over(inside))
            .drop("_block", "_weight", "_offset"))


def diff_reports(old: DataFrame, new: DataFrame, block: int = RANK_BLOCK) -> ReportDiff:
    """Compare two finding tables.

    Both need repo, stable_id, rule_id, path, line, message, sev and ``pos``, the row's
    ordinal in its report; further columns are carried along.
    """
    shared = [c for c in new.columns if c in old.columns]
    sides = old.select(*shared, F.lit(False).alias("is_new")).unionByName(
        new.select(*shared, F.lit(True).alias("is_new"))).withColumns({
            "block": F.floor(F.col("pos") / block)})
    sides = materialize(sides, "diff-sides")  # read for the blocks and again for the rows

    # Key level, from counts per block: what follows never sees a key's copies row by row.
    blocks = sides.groupBy(*EXACT, "is_new", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    of_key = Window.partitionBy(*EXACT)
    before = Window.partitionBy(*EXACT, "is_new").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    is_old = ~F.col("is_new")
    blocks = blocks.withColumns({
        "offset": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "c_old": F.coalesce(F.sum(F.when(is_old, F.col("n"))).over(of_key), F.lit(0)),
        "c_new": F.coalesce(F.sum(F.when(F.col("is_new"), F.col("n"))).over(of_key), F.lit(0)),
    }).withColumn("matched", F.least("c_old", "c_new"))
    # small next to the reports, and the source of everything below
    blocks = materialize(blocks, "diff-blocks")
    keys = blocks.groupBy(*EXACT).agg(
        F.max("c_old").alias("c_old"), F.max("c_new").alias("c_new"), F.max("matched").alias("matched"),
        F.min(F.when(is_old, F.col("first"))).alias("first_old"))
    groups = keys.groupBy(*GROUP).agg(
        F.sum("matched").alias("exact"), F.sum(F.col("c_old") - F.col("matched")).alias("n_old"),
        F.sum(F.col("c_new") - F.col("matched")).alias("n_new"))
    moved = F.least("n_old", "n_new")
    counts = groups.groupBy("repo").agg(
        F.sum(F.col("n_new") - moved).alias("added"), F.sum(F.col("n_old") - moved).alias("removed"),
        F.sum(F.col("exact") + moved).alias("unchanged"))

    # Row level, only for blocks that hold leftovers: new ones follow the matched
    # occurrences, old ones precede them (the last old occurrences are matched first).
    left_old = F.col("c_old") - F.col("matched")
    touched = blocks.where(F.when(F.col("is_new"), F.col("offset") + F.col("n") > F.col("matched"))
                           .otherwise(F.col("offset") < left_old)).select(
        *EXACT, "is_new", "block", "offset", "matched", left_old.alias("left_old"))
    inside = Window.partitionBy(*EXACT, "is_new", "block").orderBy("pos")
    rows = (sides.join(touched, [*EXACT, "is_new", "block"])
            .withColumn("occurrence", F.col("offset") + F.row_number().over(inside)))

    # Old leftovers are ordered by the first position of their key, then by occurrence.
    left = F.col("c_old") - F.col("matched")
    old_keys = (ranked(keys.where(left > 0), GROUP, "first_old", "old_upto", block, weight=left)
                .select(*EXACT, (F.col("old_upto") - left).alias("old_before")))
    old_left = (rows.where(is_old & (F.col("occurrence") <= F.col("left_old")))
                .join(old_keys, EXACT).withColumn("rank", F.col("old_before") + F.col("occurrence")))
    new_left = ranked(rows.where(F.col("is_new") & (F.col("occurrence") > F.col("matched"))), GROUP, "pos", "rank", block)
    pairs = groups.where((F.col("n_old") > 0) | (F.col("n_new") > 0)).select(*GROUP, moved.alias("moved"))
    keep = [*GROUP, *[c for c in shared if c not in GROUP], "is_new", "rank"]
    out = (old_left.select(*keep).unionByName(new_left.select(*keep)).join(pairs, GROUP)
           .where(F.col("rank") > F.col("moved"))
           .select(F.when(F.col("is_new"), "added").otherwise("removed").alias("status"), *shared))
    return ReportDiff(out, counts)


def new_at_or_above(diff: ReportDiff, level: int) -> DataFrame:
    return diff.added.where(F.col("sev") >= level)


def resolved_preview(diff: ReportDiff, shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first removed findings in report order, and how many more there are."""
    order = [c for c in report_order() if _name(c) in diff.rows.columns]
    preview = diff.removed.orderBy(*order, "pos").limit(shown)
    more = diff.removed.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    return preview, more


def _name(column) -> str:
    return str(column).split("'")[1].split(" ")[0]
