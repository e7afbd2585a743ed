import random

import pytest
import xxhash

from auditlake.llm.common import components
from auditlake.llm.simhash import drop_near_copies, fingerprint, fingerprint_links, simhash_components


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_plain_count():
    for text in (None, "", "A", "One two", "É b c D\x0bE f", "the same the same the same " * 50, "x" * 100_000):
        assert fingerprint(text) == plain(text)


def test_fingerprint_uses_the_engines_hash(spark):
    value = spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64)
    assert fingerprint("A  b\tc") == value


@pytest.mark.parametrize("count,bits", [(150, 2), (600, 2), (60, 1)])
def test_links_connect_all_pairs_within_distance(spark, count, bits):
    rnd = random.Random(count)
    prints = {rnd.getrandbits(64) for _ in range(20)}
    while len(prints) < count:
        prints.add(rnd.choice(sorted(prints)) ^ sum(1 << rnd.randrange(14 if count > 500 else 64) for _ in range(rnd.randrange(1, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in components(fingerprint_links(df, bits)).collect()}
    want = groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= bits)
    assert {n: got.get(n, n) for n in signed} == want


def test_documents_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randrange(0, 400))) for _ in range(25)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(3):
            parts = t.split(" ")
            parts[rnd.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
    texts += [None, "", " \n", base[3].upper(), base[3]]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, root int")
    prints = {i: plain(t) for i, t in zip(ids, texts)}
    want = groups(sorted(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash_components(df).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(ids)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if want[i] == i)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert simhash_components(spark.createDataFrame([], schema)).count() == 0
    assert drop_near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "z y x"), (7, None)]
    got = simhash_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("7", "7"), ("None", "3"), ("None", "None")]
    kept = drop_near_copies(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "None"]
