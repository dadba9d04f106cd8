"""The metric range join against brute force, on vectors that pivots part well, badly and not at all."""

import numpy as np
import pytest

from pagewright.llm import embedding_dedup


def made(kind):
    rng = np.random.default_rng(5)
    if kind == "random":
        base = rng.normal(size=(150, 24))
        return np.vstack([base, base[:60] + 0.08 * rng.normal(size=(60, 24))])
    if kind == "clustered":
        centres = 4 * rng.normal(size=(12, 24))
        return np.repeat(centres, 20, 0) + rng.normal(size=(240, 24)) * rng.choice([0.2, 0.5, 1.2], 240)[:, None]
    if kind == "equal":
        return np.repeat(rng.normal(size=(1, 24)), 200, 0)
    return rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(220, 24))  # all within reach of all


@pytest.mark.parametrize("blocks", [embedding_dedup.BLOCK, 16])
@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "hot"])
def test_links_match_brute_force(spark, monkeypatch, kind, blocks):
    monkeypatch.setattr(embedding_dedup, "BLOCK", blocks)
    vectors = made(kind)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= embedding_dedup.COSINE
    np.fill_diagonal(near, False)
    root = np.arange(len(vectors))
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(root))])
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_embeddings(df).collect()}
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(vectors))}


def test_folding_never_moves_vectors_apart():
    units = embedding_dedup.unit(made("random"))
    directions = np.ascontiguousarray(np.linalg.svd(units, full_matrices=False)[2][:4].T)
    folded = embedding_dedup.folded(units, directions).astype(np.float64)
    assert (folded @ folded.T >= units @ units.T - embedding_dedup.SLACK).all()


def test_neighbours_of_different_cells_meet_in_the_earlier_one():
    units = embedding_dedup.unit(made("clustered"))
    directions = np.ascontiguousarray(np.linalg.svd(units, full_matrices=False)[2][:16].T)
    points = embedding_dedup.folded(units, directions)
    home, visits = embedding_dedup.cells_of(points, points[::7])
    for x, y in zip(*np.nonzero(units @ units.T >= embedding_dedup.COSINE), strict=True):
        assert home[x] == home[y] or visits[x if home[x] > home[y] else y, min(home[x], home[y])]
    assert 1 + visits.sum(1).mean() < len(points[::7]) / 4  # clusters are ruled out
