"""Hard negatives against plain Python integers; the feasible ranges against all vectors."""

import math
import random

import numpy as np
import pytest
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from pagewright.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int"


def plain(rows, every=10):
    """The same in loops; equal rows at equal places are told apart by their place."""
    kept = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, q in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r, strict=True)), j is None, j or 0, m, n, j) for n, j, m, r in kept if n != k and len(r) == len(q)]
        for s, *_, p in sorted((x for x in scored if x[3] == label), key=lambda x: x[:5])[:5]:
            found = sorted((x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s), key=lambda x: x[:5])[:10]
            out += [(i, p, rank, x[5], -s, -x[0]) for rank, x in enumerate(found, 1)]
    return sorted(out, key=repr)


def found(spark, rows, every=10):
    df = spark.createDataFrame(rows, ROWS)
    return sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()), key=repr)


def made(kind, n=300, dims=12):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(n, dims))
    if kind == "sparse":
        v *= rng.random((n, dims)) < 0.2
    if kind == "lengths":
        v *= np.exp(2 * rng.normal(size=(n, 1)))
    if kind == "clustered":
        v = rng.normal(size=(5, dims))[rng.integers(0, 5, n)] + 0.1 * v
    if kind == "one direction":
        v = np.abs(v)
    return [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_query_matches_sql(spark, duck):
    rows = rows_of(negatives.op12_hard_negatives(spark, SF))
    assert rows and rows == rows_of_sql(duck, negatives.OP12_SQL)


@pytest.mark.parametrize("kind", ["plain", "sparse", "lengths", "clustered", "one direction"])
def test_negatives_match_plain_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "LANE", 100)
    monkeypatch.setattr(negatives, "BLOCK", 9)
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    rows = made(kind)
    assert found(spark, rows) == plain(rows) != []


def test_ties_repeats_zeros_and_other_lengths(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.0, 0.0], i % 2) for i in range(60)] + [(20, [1.0, 0.5], 0)] * 3 + [(None, [0.9, 0.5], 1), (None, [0.6, 0.3], 0)] + [(i, [1.0, 1.0, 1.0], i % 2) for i in range(100, 130)] + [(200, [], 0), (201, [], 0), (202, [], 1)]
    assert found(spark, rows) == plain(rows) != []


def test_rows_that_take_no_part(spark):
    good = made("clustered", 60)
    rows = [*good, (70, None, 1), (80, [1.0] * 12, None), (90, [None] + [1.0] * 11, 1), (100, [float("nan")] * 12, 1), (110, [float("inf")] * 12, 1)]
    assert found(spark, rows) == plain(good)
    assert found(spark, rows[60:]) == []


def test_clashing_columns(spark):
    rows = made("clustered", 80)
    df = spark.createDataFrame([(i, v, m, 1, "x", 2.5, [1]) for i, v, m in rows], "vec_id long, embedding array<double>, label int, rid int, lane string, length double, q array<int>")
    assert sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()), key=repr) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 3e5 for x in v], m) for i, v, m in made("clustered", 60)]
    assert found(spark, rows) == plain(rows) != []


def test_ranges_hold_all_that_score_enough_and_rule_out_others():
    q = np.array([[math.floor(256 * x) for x in v] for _, v, _ in made("sparse")], np.int64)
    lengths = np.sqrt((q * q).sum(1))
    order = np.argsort(-lengths)
    p, size = q[order], lengths[order]
    p, size = p[size > 0], size[size > 0]
    scores = q[:40] @ p.T
    least = np.sort(scores, axis=1)[:, -5].astype(float)
    focus, low, high = negatives.feasible(q[:40], lengths[:40], least, size[0], size[-1])
    values = (p / size[:, None])[:, focus].transpose(1, 0, 2)
    inside = ((values >= low[:, None]) & (values <= high[:, None])).all(2)
    assert inside[scores >= least[:, None]].all() and inside.mean() < 0.9
