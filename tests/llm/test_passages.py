import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from auditlake.llm import bwt_merge, passages
from auditlake.llm.bwt_merge import Transform, drop_repeated_strings, merge
from auditlake.llm.fm_index import FMIndex, WaveletMatrix, drop_repeated_passages, suffix_order


def plain_words(rows, window):
    least = defaultdict(lambda: 2**63)
    split = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            least[key] = min(least[key], i)
    out = []
    for (doc, _), (i, words) in zip(rows, split):
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((doc, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def plain_bytes(rows, window):
    seen = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        for k in range(len(d) - window + 1):
            seen[d[k:k + window]] += 1
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if seen[d[k:k + window]] > 1:
                gone[k:k + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((i, len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed, n=60, vocabulary=40):
    rnd = random.Random(seed)
    words = [f"{'é' if i % 7 == 0 else ''}w{i * 37 % 1000}" for i in range(vocabulary)]
    passage = [" ".join(rnd.choices(words, k=rnd.randrange(5, 40))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 60))) for _ in range(rnd.randrange(1, 4))]
        if rnd.random() < 0.6:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(passage))
        text = rnd.choice([" ", "\n", "  "]).join(parts)
        if rows and rnd.random() < 0.3:
            text = rnd.choice(rows)
            if rnd.random() < 0.5 and text:
                at = rnd.randrange(len(text))
                text = text[:at] + "Q" + text[at + 1:]
        rows.append(text)
    rows += [None, "", "a " * 300, "x" * 900, "one", rows[0], "the same thing again " * 30]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return list(zip(ids, rows)) + [(ids[3], rows[3]), (ids[4], "other text under an id that was used"), (None, rows[5])]


@pytest.mark.parametrize("seed,many", [(1, 2000), (2, 3)])
def test_word_passages(spark, seed, many, monkeypatch):
    monkeypatch.setattr(passages, "MANY", many)
    monkeypatch.setattr(passages, "SHARD", 2_000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, anchor int")
    got = [tuple(r) for r in drop_repeated_passages(df).collect()]
    assert sorted(got, key=str) == sorted(plain_words(rows, 13), key=str)


@pytest.mark.parametrize("seed,many,piece", [(1, 2000, 400_000), (3, 3, 500)])
def test_byte_strings(spark, seed, many, piece, monkeypatch):
    monkeypatch.setattr(passages, "MANY", many)
    monkeypatch.setattr(passages, "SHARD", 20_000)
    monkeypatch.setattr(passages, "PIECE", piece)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in drop_repeated_strings(df, 60, 20).collect()]
    assert sorted(got, key=str) == sorted(plain_bytes(rows, 60), key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_passages(empty).count() == 0 and drop_repeated_strings(empty).count() == 0


def test_wavelet_matrix_counts():
    values = np.random.default_rng(1).integers(0, 37, 1000)
    tree = WaveletMatrix(values, 6)
    at, symbols = np.arange(1001), np.arange(1001) % 37
    assert (tree.rank(symbols, at) == [(values[:a] == s).sum() for a, s in zip(at, symbols)]).all()


def test_matching_statistics():
    rnd = random.Random(3)
    texts = [[rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 30))] for _ in range(20)]
    words = np.array([w for t in texts for w in (*t, 0)])
    index = FMIndex(words, np.cumsum([len(t) + 1 for t in texts]) - 1, np.arange(20))
    query = np.array([rnd.randrange(1, 7) for _ in range(200)])
    length, low, high = index.matching_statistics(query, np.arange(200), 6)

    def occurs(p):
        return sum(t[i:i + len(p)] == p for t in texts for i in range(len(t) - len(p) + 1))
    for e in range(200):
        want = max(k for k in range(0, min(6, e + 1) + 1) if k == 0 or occurs(query[e - k + 1:e + 1].tolist()))
        assert length[e] == want
        if want:
            assert high[e] - low[e] == occurs(query[e - want + 1:e + 1].tolist())


@pytest.mark.parametrize("depth", [8, 10, 7])
def test_merged_transforms_give_common_prefixes(depth):
    rnd = random.Random(4)
    strings = [bytes(rnd.choices(b"ab\0", [5, 5, 1], k=rnd.randrange(1, 40))) for _ in range(12)]
    parts = [Transform(strings[:5]), Transform(strings[5:6]), Transform(strings[6:])]
    step = bwt_merge._steps(parts, depth)[0]
    common = merge(parts, depth)
    suffixes = [s[i:] for s in strings for i in range(len(s) + 1)]
    at = 0
    for part, group in zip(parts, (strings[:5], strings[5:6], strings[6:])):
        own = [s[i:] for s in group for i in range(len(s) + 1)]
        for row, start in enumerate(part.order):
            me = own[start]
            if start in np.cumsum([len(s) + 1 for s in group]) - 1:
                continue  # a terminator
            best = max((len(p) for p in (me[:k] for k in range(depth + 1)) if sum(s[:len(p)] == p and len(s) >= len(p) for s in suffixes) > 1), default=0)
            assert common[at + row] == best // step * step
        at += len(part.order)


def test_hash_of_kept_text_is_that_of_the_words(spark):
    df = spark.createDataFrame([(1, " a\tb \n c ")], "doc_id long, text string")
    row = drop_repeated_passages(df).first()
    assert hashlib.sha256(row.kept.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def test_suffix_order():
    rnd = random.Random(6)
    for top in (1, 3, 300, 100_000):
        values = np.array([rnd.randrange(top) for _ in range(500)] * 2)
        assert suffix_order(values).tolist() == sorted(range(1000), key=lambda i: values[i:].tolist())
