import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from auditlake.llm import token_alignment
from auditlake.llm.queries import QUERIES
from auditlake.llm.token_alignment import A_PATH, B_PATH, align_tokens, byte_alphabet, link_statistics, pair_counts, score_links
from auditlake.session import materialize


@pytest.fixture(scope="module")
def library():
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_text(library, text):
    """Groups and links of one whole text, byte by byte."""
    a, b = library
    if not text:
        return [], []
    alphabet, data = byte_alphabet(), (" " + text).encode()
    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts, b_parts = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids], [piece(i) for i in b_ids]
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return [], []
    a_of, b_of = ([k for k, p in enumerate(parts) for _ in p] for parts in (a_parts, b_parts))
    links = Counter((a_ids[x], b_ids[y]) for x, y in dict.fromkeys(zip(a_of, b_of)))
    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out
    a_ends, b_ends = ends(a_parts), ends(b_parts)
    groups, low = [], 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        groups.append(([i for i, e in zip(a_ids, a_ends) if low < e <= cut], [i for i, e in zip(b_ids, b_ends) if low < e <= cut]))
        low = cut
    return groups, links


def plain(library, docs):
    made = [(d, *plain_text(library, t)) for d, t in docs]
    count = Counter(p for _, _, links in made for p in links)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for d, groups, links in made:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()) if links else 0,
                    sum(n for p, n in links.items() if count[p] == most[p[0]]) if links else 0, sum(n * count[p] for p, n in links.items()) if links else 0,
                    sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def samples():
    rnd = random.Random(5)
    fixed = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a  b", "x ᠎b", "　 y", "tab\t x", "line\n\n  next", "it's we'll DON'T 's", "▁marker", "in ▁ side",
             "<|endoftext|> and </s> <s> <unk> <0x41>", "日本語 テキスト と 漢字", "emoji 😀 👩‍👩‍👧 x", "\u0000 nul", "é ́x", "naïve café straße", "1234 5678,90 €5",
             "a" * 5000, " " * 300 + "x", "﻿ bom", "  sep  ", "x​ y", "Ω≈ç√ ∫˜µ", "\x1c \x1d y", "\x85 z"]
    parts = ["the", "Ing", "'s", "é", "ß", "日", " ", " ", " ", " ", "  ", "\n", "\t", "q", "😀", "1", "23", ".", "…", "ñó", " ", "é", "_", "--"]
    return fixed + ["".join(rnd.choices(parts, k=rnd.randrange(1, 80))) for _ in range(400)]


def test_every_row_equals_a_byte_by_byte_version(spark, library):
    docs = [(i, t) for i, t in enumerate(samples())] + [(7, "repeated row"), (7, "repeated row"), (None, "no id")]
    table = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, aligned string, n_a string").repartition(3)
    got = link_statistics(table)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got, want = sorted((tuple(r) for r in got.collect()), key=repr), plain(library, docs)
    texts = dict(docs)
    assert len(got) == len(want) and [(texts[g[0]], g, w) for g, w in zip(got, want) if g != w] == []
    assert sum(r[1] == 0 for r in got) < 40


@pytest.mark.parametrize("sent", [0, 1, 40, 10_000])
def test_joined_and_sent_pairs_score_alike(spark, library, sent):
    docs = [(i, t) for i, t in enumerate(samples()[30:110])]
    aligned = materialize(align_tokens(spark.createDataFrame(docs, "doc_id long, text string")), "aligned")
    counts = materialize(pair_counts(aligned), "pairs")
    got = score_links(aligned, counts, sent_pairs=sent)
    assert got.columns == ["doc_id", "text", "aligned", "n_best", "count_sum"]
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in got.collect()) == [(r[0], r[5], r[6]) for r in sorted(plain(library, docs))]


def test_a_small_cache_gives_the_same(spark, library, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 2000)
    docs = [(i, t) for i, t in enumerate(samples()[-150:] * 2)]
    assert sorted((tuple(r) for r in link_statistics(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr) == plain(library, docs)


def test_groups_in_full_and_empty_tables(spark, library):
    table = spark.createDataFrame([(1, "unbelievable things"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.aligned for r in align_tokens(table).collect()}
    groups, _ = plain_text(library, "unbelievable things")
    assert rows[1].groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    assert rows[2].groups == rows[2].groups_sha256 == "" and rows[2].pairs == [] and rows[2].n_a == 0
    assert link_statistics(table.limit(0)).count() == 0 and link_statistics(table.where("doc_id = 2")).count() == 1


def test_long_text_without_spaces(spark, library):
    rnd = random.Random(2)
    text = "".join(rnd.choices("abcdefghij日本é", k=300_000))
    row = link_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_a == len(library[0].encode(" " + text, add_special_tokens=False).ids) and row.n_b == len(library[1].encode(text))


def test_query_against_a_plain_version(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    few = sorted(docs, key=lambda d: len(d[1] or ""))
    got = QUERIES["op11_token_alignment"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(library, few)
    assert got.where(F.col("n_links") < F.col("n_groups")).count() == 0
