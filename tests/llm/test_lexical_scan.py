import math
import random
import re
from collections import Counter

from auditlake.llm import lexical_scan
from auditlake.llm.lexical_scan import fold, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id string, score string", "item_id long, text string, rank string"


def plain(docs, items, top=10):
    """Every score of every item by the formula, ranked; one list per item row."""
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            total = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(c):
                m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
                total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    made = rank_documents(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3),
                          spark.createDataFrame([(*i, "z") for i in items], ITEMS), **options)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "naïve", "x1", "日本", "l", "long" * 90, "LONG" * 90, "other" * 70, *(f"w{i}" for i in range(60))]
    def text(k):
        return "".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", "\n", "-", "\x00", "_"]) for _ in range(k))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[9][1]), (9999, None), (10000, "")]
    return docs, [(i, text(rnd.randrange(1, 12))) for i in range(15)] + [(3, text(4)), (None, "the w1"), (77, None), (78, ""), (79, "unseen"), (80, "w1 w1")]


def test_ranks_equal_the_formula(spark):
    docs, items = corpus(1)
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, items, top=3) == plain(docs, items, top=3)


def test_items_dealt_over_passes_rank_alike(spark):
    docs, items = corpus(2, 80)
    assert ranked(spark, docs, items, block_bytes=200) == plain(docs, items)


def test_small_steps_rank_alike(spark, monkeypatch):
    docs, items = corpus(3, 120)
    monkeypatch.setattr(lexical_scan, "ADDITIONS", 7)
    monkeypatch.setattr(lexical_scan, "TASKS", 1)
    assert ranked(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(4, 20)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, docs, [(1, "  "), (2, None)]) == []
    assert ranked(spark, [(1, None), (2, "--")], items) == []


def test_terms_of_any_length_between_guards():
    assert fold("Ab-cÉ  x\x00y") == (" ab cÉ  x y ", 4)
    long, n = fold("a " + "B" * 3_000_000 + " b")
    assert n == 3 and len(long) < 100 and long == fold("A " + "b" * 3_000_000 + "\tB")[0]
    assert fold("b" * 2_999_999)[0].strip() not in long
    assert fold("") == ("  ", 0)


def test_a_very_long_text_is_counted_whole(spark):
    docs = [(1, "w " * 400_000 + "needle"), (2, "hay " * 10), (3, "needle " + "hay " * 9)]
    items = [(1, "Needle"), (2, "hay w")]
    assert ranked(spark, docs, items) == plain(docs, items)
