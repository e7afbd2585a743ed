import random
import tempfile

import numpy as np
import pytest

import corpus_pipeline
from auditlake.llm.mixing import mix_sizes
from auditlake.llm.toxicity import score_toxicity
from auditlake.llm.unigram import MODEL_PATH, Encoder, Model
from .test_native import plain_lines
from .test_simhash import groups, plain


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(3, 90))]
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["scum", "idiot", "vequer"]))
        text = " ".join(words)
        if i % 3 == 0:
            text = "home about menu\n" + text
        rows.append((i, text, "en", rnd.choice(["a", "a", "a", "b", "c"]), len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + k, rows[k + 1][1] + (" end" if k % 2 else ""), "en", "b", 5) for k in range(20)]
    rows += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, "x" * 5000, "de", "c", 5000)]
    where = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def table(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    now = docs
    for name in list(stages)[:-1]:
        before, rows = now, [(r.doc_id, r.text, r.source) for r in now.collect()]
        now = corpus_pipeline.materialize(stages[name](spark, before, corpus), name)
        assert now.columns == docs.columns, name
        if name == "toxicity":
            scores = score_toxicity(before, spark.read.parquet(f"{corpus}/labels.parquet")).collect()
            want = [(r.doc_id, r.text, r.source) for r in scores if r.score < 0.5]
            assert {d for d, _, _ in rows if d < 240 and d % 7} <= {d for d, _, _ in want}
            assert sum(d < 240 and d % 7 == 0 for d, _, _ in want) <= 2
        elif name == "line_dedup":
            want = [(d, t, s) for (d, t), (_, _, s) in zip(plain_lines(rows, 0.02, 5), rows)]
            assert not any((t or "").startswith("home") for _, t, _ in want)
        elif name == "simhash_near_dedup":
            prints = {d: plain(t) for d, t, _ in rows}
            root = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
            want = [r for r in rows if root[r[0]] == r[0]]
            assert len(want) < len(rows)
        else:
            taken = {r.doc_id: r.taken for r in mix_sizes(before).collect()}
            got = {}
            for r in now.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
            assert got == {d: n for d, n in taken.items() if n}
            continue
        assert table(now) == sorted(want, key=str), name
    out = stages["sentencepiece"](spark, now, corpus).collect()
    encoder, texts = Encoder(Model.read(MODEL_PATH)), {}
    for r in now.collect():
        texts.setdefault(r.doc_id, []).append(np.frombuffer(encoder.encode([r.text])[0], "<i4").tolist())
    for r in out:
        assert r.decodes and r.n_tokens == len(r.tokens) and list(r.tokens) in texts[r.doc_id]
    assert len(out) == now.count()


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "source", "tokens", "n_tokens", "decodes"] and out.count() > 100


def test_one_whole_text_of_a_copy_group_survives_three_stages(spark):
    copied = "a passage of several lines\nthat a third of a source copies\nand no other page has"
    copies = [(i, copied + ("\n" if i % 3 else " \t\r\n\n"), "en", "a", 1) for i in range(100)]
    others = [(1000 + i, f"menu\n{' '.join(f'w{i * 31 + k * 7}' for k in range(30))}", "en", "a", 1) for i in range(200)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.materialize(corpus_pipeline.drop_boilerplate(spark, docs, ""), "lines")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, lines, "").collect()}
    assert [d for d in kept if d < 1000] == [0] and kept[0] == copies[0][1]
    assert all(kept[d] == t.split("\n")[1] for d, t, *_ in others)
