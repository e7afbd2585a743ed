import hashlib

import numpy as np

from auditlake.llm.exact_dedup import CuckooFilter, LiveDigests, delete, digests, exact_duplicates, insert


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_finds_what_was_inserted_and_forgets_what_was_deleted():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    index = CuckooFilter(5000)
    assert index.insert(hashes) and index.contains(hashes).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert index.contains(other).mean() < 0.01
    index.delete(hashes[:2500])
    assert index.contains(hashes[2500:]).all() and index.contains(hashes[:2500]).mean() < 0.01


def test_filter_reports_overflow():
    index = CuckooFilter(16)
    assert not index.insert(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))


def test_overflow_resizes_from_stored_keys():
    live = LiveDigests()
    for start in range(0, 30_000, 1000):
        part = [key(i) for i in range(start, start + 1000)]
        live.insert(part, [1] * 1000, list(range(start, start + 1000)))
    assert len(live.entries) == 30_000 and live.filter.buckets * 4 >= 30_000
    live.insert([key(5), key(5)], [1, 1], [99, 2])
    assert live.entries[key(5)] == [3, 99]
    live.delete([key(6), key(5), key(-1)], [1, 1, 1])
    assert key(6) not in live.entries and live.entries[key(5)][0] == 2


def test_insert_and_delete_on_tables(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    index = insert(digests(docs.where("doc_id < 30")), shards=3)
    index = insert(digests(docs.where("doc_id >= 30")), index, 3)
    want = {hashlib.sha256(f"t{k}".encode()).digest(): (len(range(k, 50, 7)), max(range(k, 50, 7))) for k in range(7)}
    assert {bytes(r.digest): (r.n, r.keep_id) for r in index.collect()} == want
    index = delete(digests(docs.where("text = 't3' or doc_id = 0")), index, 3)
    got = {bytes(r.digest): r.n for r in index.collect()}
    assert len(got) == 6 and got[hashlib.sha256(b"t0").digest()] == 7


def test_documents(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (2, "A"), (3, None), (4, ""), (None, "a"), (None, "q"), (9, "x" * 300_000), (8, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_duplicates(docs).collect())
    assert got == sorted([("1", "5", 4, False), ("5", "5", 4, True), ("5", "5", 4, True), ("2", "2", 1, True), ("3", "4", 2, False),
                          ("4", "4", 2, True), ("None", "5", 4, False), ("None", "None", 1, True), ("9", "9", 2, True), ("8", "9", 2, False)])
    assert {r.text_sha256 for r in exact_duplicates(docs).where("doc_id = 3").collect()} == {hashlib.sha256(b"").hexdigest()}
    assert exact_duplicates(docs.limit(0)).count() == 0
