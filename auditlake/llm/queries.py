"""Registered queries of this package and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import (bwt_merge, exact_dedup, fm_index, lexical_scan, line_dedup, mixing, pii, simhash, token_alignment, toxicity, unigram,
                           url_filter, vectors)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_url_filters", url_filter.oracle())
def op1(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template")


@query("op2_source_mixing")
def op2(spark, sf_dir):
    return mixing.mix_sizes(documents(spark, sf_dir))


@query("op3_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""")
def op3(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query("op4_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
m AS (SELECT rid, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
c AS (SELECT source, body, count(DISTINCT rid) AS pages FROM m WHERE body <> '' GROUP BY source, body),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT c.source, c.body, true AS gone FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 5 AND pages > 0.02::DOUBLE * total),
k AS (SELECT m.rid, count(*) AS n_lines, count(gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL) AS kept
  FROM m LEFT JOIN b ON m.source IS NOT DISTINCT FROM b.source AND m.body = b.body GROUP BY m.rid)
SELECT doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
""")
def op4(spark, sf_dir):
    out = line_dedup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"), lines="n_lines", dropped="n_dropped")
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    out = fm_index.drop_repeated_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    out = bwt_merge.drop_repeated_strings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    out = unigram.encode(documents(spark, sf_dir).select("doc_id", "text"), decodes="decodes")
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_xxhash64"), "decodes")


@query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    return simhash.simhash_components(documents(spark, sf_dir), shingle=3, max_bits=2)


@query("op10_embedding_near_dedup")
def op10(spark, sf_dir):
    return vectors.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return token_alignment.link_statistics(documents(spark, sf_dir).select("doc_id", "text"))


@query("op12_pii")
def op12(spark, sf_dir):
    found = pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "personal_data")
    spans = F.col("personal_data")
    counts = [pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = pii.listed(F.filter(spans, lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op13_lexical_search", r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents, letters),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, letters),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS docs, coalesce(sum(n), 0)::BIGINT AS terms FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
p AS (SELECT f.doc_id, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))) AS points
  FROM f JOIN n ON f.doc_id = n.doc_id JOIN w ON f.term = w.term, s),
r AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM q JOIN p ON q.term = p.term GROUP BY item_id, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
""")
def op13(spark, sf_dir):
    return lexical_scan.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
