"""Centroid clustering against plain Python integers; the bounds against exact distances."""

import hashlib
import math
import random

import numpy as np
from conftest import SF, rows_of, rows_of_sql

from pagewright.llm import clustering

ROWS = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, dims=64):
    """The same in loops: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    label = lambda: [min((far(q, c), n) for n, c in enumerate(centres)) for _, q in kept]
    for _ in range(rounds):
        labels = label()
        for n in range(len(centres)):
            own = [q for (_, q), (_, m) in zip(kept, labels, strict=True) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    labels = label()
    inertia = {n: sum(d for d, m in labels if m == n) for n in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), names[n]) for (i, _), (d, n) in zip(kept, labels, strict=True)), key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS)
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in clustering.centroid_clusters(df, **kw).collect()), key=repr)


def near(seed, n=120, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(10)]
    return [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in centres[i % 10]]) for i in range(n)]


def test_query_matches_sql(spark, duck):
    assert rows_of(clustering.op11_clustering(spark, SF)) == rows_of_sql(duck, clustering.OP11_SQL)


def test_clusters_match_plain_loops(spark):
    for rows in (near(1), near(2, spread=0.6)):
        assert found(spark, rows) == plain(rows)


def test_ties_repeats_and_equal_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert found(spark, same) == plain(same)  # all centroids equal: the smallest number takes all
    rows = near(3, 40) + near(3, 40) + [(7, [1.0] + [0.0] * 63)] * 5 + [(7, [0.0, 1.0] + [0.0] * 62)]
    assert found(spark, rows) == plain(rows)


def test_rows_that_take_no_part(spark):
    rows = [(1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 65), (5, [None] + [0.1] * 63), (6, [float("nan")] + [0.1] * 63), (7, [float("inf")] + [0.1] * 63), (None, [0.25] * 64), (8, [0.0] * 64), (9, [-0.3] * 64)]
    assert found(spark, rows) == plain(rows)
    assert [r[0] for r in found(spark, rows)] == [8, 9, None]
    assert found(spark, rows[:7]) == []


def test_extra_columns_with_clashing_names(spark):
    rows = near(4, 30)
    df = spark.createDataFrame([(i, v, "x", [1], 5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, q array<int>, inertia int")
    got = sorted((tuple(r) for r in clustering.centroid_clusters(df).collect()), key=repr)
    assert got == plain(rows)


def test_bounds_hold_and_rule_out(spark):
    q = np.array([np.floor(1024 * np.array(v)) for _, v in near(5, 300)], np.int64)
    simplex = clustering.Simplex(clustering.pivots_of(q))
    apexes, d = simplex.apexes(q), clustering.squared(q, q[:10])
    tops = apexes[:10]
    low = ((apexes[:, None] - tops) ** 2).sum(2)
    high = low + 4 * np.outer(apexes[:, -1], tops[:, -1])
    slack = clustering.SLACK * ((apexes**2).sum(1)[:, None] + (tops**2).sum(1))
    assert (low <= d + slack).all() and (d <= high + slack).all()
    left = clustering.candidates(apexes, tops)
    assert left[np.arange(len(q)), d.argmin(1)].all() and left.mean() < 0.5
