import random
import zlib

import pytest

from auditlake.llm.toxicity import FEATURES, _Words, drop_toxic, features, held_out, learn_lexicon, learning_labels, learning_rows, score_toxicity


def test_features_of_plain_texts():
    words = _Words({"idiot": 3.0, "vequ*": 2.0})
    row = dict(zip(FEATURES, features("You IDIOT!! a more vequons 1d10t you", words)))
    assert row["lexicon_hits"] == pytest.approx(1.3863, abs=1e-3) and row["capital_words"] == pytest.approx(1 / 7)
    assert row["near_second_person"] == 0.75 or row["near_second_person"] == 1.0
    assert row["obfuscated_hits"] == pytest.approx(1 / 7) and row["second_person"] == pytest.approx(2 / 7)
    for text in (None, "", " \n", "x" * 300_000, "!!! ???"):
        assert len(features(text, words)) == len(FEATURES)


def test_held_out_rows(spark):
    rows = spark.range(200).selectExpr("id AS doc_id").withColumn("out", held_out()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.fixture
def tables(spark):
    rnd = random.Random(1)
    bad = ["scum", "idiot", "vequons", "vequer", "vequit"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rnd.randrange(150)}" for _ in range(rnd.randrange(5, 80))]
        toxic = i % 6 == 0
        for _ in range(rnd.randrange(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), 1.0, "x"))
        if i % 10 < 9:
            labels.append((i, int(toxic)))
    rows += [(700, None, 1.0, "x"), (701, "", 1.0, "x"), (0, rows[0][1], 1.0, "x"), (None, "scum idiot scum idiot scum", 1.0, "x")]
    labels += [(6, 0), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features double, rawPrediction string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_never_learns_from_held_out_rows(spark, tables):
    docs, labels = tables
    rows = learning_rows(docs, learning_labels(labels))
    assert learning_labels(labels, 50, 20).count() == 50 and learning_labels(labels, 50, 20).where("fit").count() == 20
    assert rows.where(held_out()).count() == 0
    lexicon = learn_lexicon(rows)
    assert {"scum", "idiot", "vequ*"} <= set(lexicon) and not any(t.startswith("w") for t in lexicon)


def test_scores_separate_held_out_documents(tables):
    docs, labels = tables
    out = score_toxicity(docs, labels, "score")
    assert out.columns == [*docs.columns, "score"]
    rows = out.withColumn("out", held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.out and r.doc_id is not None and r.doc_id < 600]
    assert sum((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.95
    assert [r.score for r in rows if r.doc_id is None][0] >= 0.5 > max(r.score for r in rows if r.doc_id in (700, 701))
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_without_both_labels(spark, tables):
    docs, labels = tables
    assert {r.score for r in score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0
