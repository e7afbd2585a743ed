"""Site-relative line deduplication: lines that a large part of a site's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditlake.llm.common import free_name, small_side
from auditlake.session import materialize

EDGE = " \\t\\r"


def _keys(text: str) -> str:
    """SQL: 16-byte keys of a text's lines, in order; null for blank lines."""
    return (f"transform(transform(split({text}, '\\n', -1), l -> btrim(l, '{EDGE}')), "
            "l -> IF(l = '', CAST(NULL AS BINARY), unhex(md5(l))))")


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = 0.02, min_pages: int = 5, copies_once: bool = False) -> DataFrame:
    """Boilerplate lines of each site: site, key, pages, site_pages. See :func:`drop_boilerplate`.

    Each page contributes a line once; counts are added up on the map side, so neither a site with a third of all pages
    nor a line on every page meets as rows in one task. The same holds for copies that are reduced to one page.
    """
    pages = docs.select(F.col(site).alias("site"), F.expr(f"filter({_keys('text')}, k -> k IS NOT NULL)").alias("keys"))
    if copies_once:
        pages = pages.distinct()
    lines = pages.select("site", F.explode(F.array_distinct("keys")).alias("key"))
    counts = lines.groupBy("site", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("site").alias("of")).agg(F.count("*").alias("site_pages"))
    return (counts.join(totals, counts.site.eqNullSafe(totals.of))
            .where(F.col("pages") > F.lit(ratio) * F.col("site_pages")).select("site", "key", "pages", "site_pages"))


def drop_boilerplate(docs: DataFrame, site: str = "source", ratio: float = 0.02, min_pages: int = 5,
                     lines: str | None = None, dropped: str | None = None, copies_once: bool = False) -> DataFrame:
    """``docs`` without the lines that more than ``ratio`` of their site's pages, and at least ``min_pages``, contain.

    Lines end at newlines and are compared without spaces, tabs and carriage returns at their ends; blank lines are
    neither counted nor dropped. ``min_pages`` keeps small sites whole, where every line would exceed a ratio. A null
    site is a site of its own; null texts stay null and empty ones empty; a text all of whose lines go becomes empty.
    Repeated rows are pages of their own; with ``copies_once``, rows of a site whose non-blank lines are equal in order are one
    page in both counts, so a group of copies does not make its own lines boilerplate. A column ``n_chars`` follows the text; others are unchanged whatever their
    names. ``lines`` and ``dropped`` name optional columns for the number of lines before, and of lines dropped. An empty
    table gives no rows.
    """
    common = materialize(boilerplate(docs, site, ratio, min_pages, copies_once), "boilerplate")
    pages = docs.select("doc_id", F.col(site).alias("page_site"), F.explode(F.expr(_keys("text"))).alias("page_key")).where("page_key IS NOT NULL")
    listed = small_side(common.select("site", "key"), F.lit(80))
    drops = pages.join(listed, (F.col("page_key") == F.col("key")) & F.col("page_site").eqNullSafe(F.col("site")))
    # what a page drops follows from its site and its lines, so rows that share an id and a site may share a set
    drops = drops.groupBy(F.col("doc_id").alias("drop_id"), F.col("site").alias("drop_site")).agg(F.collect_set("key").alias("keys"))
    drops = materialize(drops, "page-boilerplate")
    names = {c: free_name(docs, c) for c in ("drop_id", "drop_site", "keys")}
    drops = small_side(drops.withColumnsRenamed(names), F.size(names["keys"]) * 24 + 80)
    same = docs["doc_id"].eqNullSafe(drops[names["drop_id"]]) & docs[site].eqNullSafe(drops[names["drop_site"]])
    keys, was = names["keys"], free_name(docs, "was")
    gone = f"filter({_keys(was)}, k -> k IS NOT NULL AND array_contains({keys}, k))"
    kept = (f"IF({keys} IS NULL, {was}, array_join(filter(split({was}, '\\n', -1), "
            f"l -> NOT coalesce(array_contains({keys}, unhex(md5(btrim(l, '{EDGE}')))), false) OR btrim(l, '{EDGE}') = ''), '\\n'))")
    out = docs.join(drops, same, "left").withColumnRenamed("text", was).withColumn("text", F.expr(kept))
    extra = []
    if lines:
        extra.append(F.coalesce(F.when(F.col(was).isNotNull(), F.size(F.split(was, "\n", -1))), F.lit(0)).cast("long").alias(lines))
    if dropped:
        extra.append(F.expr(f"CAST(IF({keys} IS NULL, 0, size({gone})) AS BIGINT)").alias(dropped))
    columns = [F.when(F.col(keys).isNull(), F.col(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else c
               for c in docs.columns]
    return out.select(*columns, *extra)
