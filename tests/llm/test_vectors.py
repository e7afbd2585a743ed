import numpy as np
import pytest

from auditlake.llm import vectors
from auditlake.llm.vectors import Quantiser, link_vectors


def brute(rows, threshold):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in zip(*np.nonzero(near)):
        a, b = find(a), find(b)
        if ids[a] <= ids[b]:
            root[b] = a
        else:
            root[a] = b
    return [(ids[k], int(near[k].sum()), ids[find(k)]) for k in range(len(ids))]


def clustered(seed, n, d, noise):
    dice = np.random.default_rng(seed)
    centers = dice.normal(size=(8, d))
    x = centers[dice.integers(0, 8, n)] + dice.normal(size=(n, d)) * noise
    x[:40] = x[40:80] + dice.normal(size=(40, d)) * 0.05
    x[80:90] = x[90]
    x[91] = 3 * x[92]
    ids = dice.permutation(n)
    return list(zip(ids.tolist(), np.round(x, 3).astype(np.float32).tolist()))


@pytest.mark.parametrize("seed,noise,tile", [(1, 1.0, 3000), (2, 0.3, 40)])
def test_links_against_brute_force(spark, seed, noise, tile, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = clustered(seed, 400, 16, noise)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rep int")
    got = link_vectors(df).collect()
    want = brute(rows, 0.9)
    found, true = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.99 * true <= found <= true and len(got) == len(rows)
    if found == true:
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    got = {str(r.vec_id): (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": (2, 1, True), "2": (2, 1, False), "3": (0, 3, True), "4": (0, 4, True), "5": (0, 5, True), "6": (0, 6, True), "7": (0, 7, True),
                   "8": (0, 8, True), "9": (0, 9, True), "None": (0, None, True), "10": (0, 10, True)}
    assert link_vectors(spark.createDataFrame([], schema)).count() == 0
    assert link_vectors(spark.createDataFrame([(1, None)], schema)).count() == 1


def test_lookup_never_rules_out_a_near_vector():
    dice = np.random.default_rng(5)
    x = vectors._unit(dice.normal(size=(500, 32)))
    model = Quantiser(x, 20, 0.6)
    home, _, codes, error = model.assign(x)
    for c in range(len(model.centers)):
        mine = np.flatnonzero(home == c)
        if len(mine):
            i, j = model.candidates(x, c, codes[mine], error[mine])
            got = set(zip(i.tolist(), mine[j].tolist()))
            near = np.linalg.norm(x[:, None] - x[None, mine], axis=2) <= 0.6
            assert {(a, int(mine[b])) for a, b in zip(*np.nonzero(near))} <= got


@pytest.mark.parametrize("inner,d", [(24, 256), (16, 33)])
def test_pairs_unlike_the_sample_are_found_and_count_for_both(spark, inner, d):
    dice = np.random.default_rng(inner)
    base = vectors._unit(dice.normal(size=(900, inner)))
    offset = dice.normal(size=base.shape)
    offset = vectors._unit(offset - (offset * base).sum(1)[:, None] * base)
    near = base + np.tan(np.arccos(dice.uniform(0.901, 0.93, size=(900, 1)))) * offset
    x = np.concatenate([base, near]) @ np.linalg.qr(dice.normal(size=(d, inner)))[0].T
    rows = list(enumerate(x.tolist()))
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=160).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)


def test_sketches_hold_their_error():
    x = vectors._unit(np.random.default_rng(6).normal(size=(200, 7)))
    back, blur = vectors._unsketched(vectors.pa.chunked_array([vectors._sketches(x)]), 7)
    assert (np.linalg.norm(x - back, axis=1) <= blur + 1e-6).all() and blur.max() < 0.25


def test_every_dimension_links_within_itself(spark):
    parts = [clustered(seed, n, d, 0.5) for seed, n, d in ((3, 300, 16), (4, 200, 24), (5, 100, 5))]
    parts.append([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])])
    rows, want = [], []
    for k, part in enumerate(parts):
        rows += [(i + 1000 * k, v) for i, v in part]
        want += brute([(i + 1000 * k, v) for i, v in part], 0.9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for sample in (16_384, 20):
        got = link_vectors(df, sample=sample).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
