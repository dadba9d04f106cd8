"""Centroid clustering with n-simplex bounds before exact integer comparison (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut

CENTROIDS, ROUNDS, SCALE, DIMS, SALT = 8, 10, 1024, 64, "3"
#: Pivots at most, and the vectors that the driver sees to choose them: they make the bounds sharp or not, never the result.
PIVOTS, SAMPLE = 16, 512
#: A pivot stands at least so far from the span of those before it, as a share of the first distance: else apexes would lose precision.
LEAST_HEIGHT = 1e-2
#: Integer components stay under this, so that a squared distance of DIMS components fits 64 bits.
LIMIT = 1 << 27
#: What double precision can err in a squared bound, as a share of the squared lengths of both apexes, generously.
SLACK = 1e-9
ROWS_AT_ONCE = 4096


def finite(x):
    return F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def integers(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """(vec_id, q): floor(scale * component) of the vectors with exactly `dims` components, all finite."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & F.forall("embedding", finite))
    return kept.select("vec_id", F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances")).cast("array<int>")).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())


def squared(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer points."""
    q = q.astype(np.int64)
    return np.stack([((q - p) ** 2).sum(1) for p in points.astype(np.int64)], axis=1)


def pivots_of(sample: np.ndarray) -> np.ndarray:
    """Vectors of the sample, each the farthest from the span of those before it, until none is far."""
    rest = (sample - sample[0]).astype(np.float64)
    taken, first = [0], None
    while len(taken) < min(PIVOTS, sample.shape[1]):
        heights = np.sqrt((rest * rest).sum(1))
        at = int(heights.argmax())
        first = heights[at] if first is None else first
        if not heights[at] > LEAST_HEIGHT * first:
            break
        taken.append(at)
        way = rest[at] / heights[at]
        rest = rest - np.outer(rest @ way, way)
    return sample[taken]


class Simplex:
    """The base simplex of the pivots, and the apex over it that a vector's distances to the pivots make.

    Base vertices come from the pivots' distances among each other (Cholesky's root of their Gram matrix); the first
    stands at the origin. An apex has a coordinate for each other pivot and its height over the base. The distance of
    two vectors is no less than that of their apexes, and no more than that to the other's mirror image under the base.
    """

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        d = squared(pivots, pivots).astype(np.float64)
        gram = (d[1:, :1] + d[:1, 1:] - d[1:, 1:]) / 2
        self.base = np.linalg.cholesky(gram) if len(gram) else gram
        self.lengths = (self.base * self.base).sum(1)

    def apexes(self, q: np.ndarray) -> np.ndarray:
        d = squared(q, self.pivots).astype(np.float64)
        foot = np.linalg.solve(self.base, (d[:, :1] + self.lengths - d[:, 1:]).T / 2).T if len(self.base) else np.zeros((len(q), 0))
        return np.hstack([foot, np.sqrt(np.maximum(0, d[:, :1] - (foot * foot).sum(1, keepdims=True)))])


def candidates(apexes: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest to each vector: those whose lower bound is no more than the least upper bound."""
    lengths = (apexes * apexes).sum(1)[:, None] + (tops * tops).sum(1)
    low = lengths - 2 * apexes @ tops.T
    high = low + 4 * np.outer(apexes[:, -1], tops[:, -1])
    return low - SLACK * lengths <= (high + SLACK * lengths).min(1, keepdims=True)


def nearest(q: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, ties to the smaller number. The bounds rule centroids out; integers decide among those left."""
    open_ = candidates(apexes, tops)
    found = open_.argmax(1)
    many = np.flatnonzero(open_.sum(1) > 1)
    if len(many):
        row, c = np.nonzero(open_[many])
        d = ((q[many[row]].astype(np.int64) - centroids[c]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, starts), np.diff(starts, append=len(row))))
        first = best[np.unique(row[best], return_index=True)[1]]  # centroids go up within a row
        found[many] = c[first]
    return found


def with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """rows (vec_id, q) with their apex: what the rounds read instead of distances to pivots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(simplex.apexes(matrix(b.column(1))))], ["vec_id", "q", "apex"])

    return rows.mapInArrow(add, f"vec_id {dict(rows.dtypes)['vec_id']}, q array<int>, apex array<double>")


def moved(cached: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: each task sums its vectors by cluster, Spark adds the tasks' sums, k * (dims + 1) numbers reach the driver."""
    tops, (k, dims) = simplex.apexes(centroids), centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)  # the last place counts
        for b in batches:
            q, apexes = matrix(b.column(0)), matrix(b.column(1))
            for at in range(0, len(q), ROWS_AT_ONCE):
                part = q[at : at + ROWS_AT_ONCE].astype(np.int64)
                np.add.at(total, nearest(part, apexes[at : at + ROWS_AT_ONCE], centroids, tops), np.hstack([part, np.ones((len(part), 1), np.int64)]))
        cluster, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel()), pa.array(place.ravel()), pa.array(total.ravel())], ["cluster", "place", "total"])

    added = cached.select("q", "apex").mapInArrow(sums, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k, dims + 1), object)
    for r in added:
        total[r["cluster"], r["place"]] = r["total"]
    return np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(c) for t, c in zip(total, centroids, strict=True)], np.int64)


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, salt: str = SALT) -> DataFrame:
    """Per vector (vec_id, embedding): vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly `dims` finite components take part, as integers floor(scale * x); all others are left out. The
    first centroids are the k vectors with the smallest sha256 of `salt:vec_id`. A round assigns each vector to its
    nearest centroid and moves each centroid to its vectors' exact floor mean; a centroid without vectors stays.

    N-simplex projection: distances to a few pivots become, once, the coordinates of an apex, which are cached beside
    the integers. In each round the apexes' Euclidean lower and upper bounds leave few centroids for a vector, and those
    are compared in exact integers. All rows stay where they are: a round is one pass that returns sums. Rounds end
    early where no centroid moved, as the rest would change nothing.

    Repeated rows count each. A null vec_id is kept, and starts no centroid before any other row does. Rows that tie in
    the sha256 start in the order of their components. Fewer than k vectors make fewer centroids; an empty table gives no
    rows. A component of LIMIT or more is an error, as distances would leave 64 bits. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale, dims)
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(key.asc_nulls_last(), "q").limit(k).collect()
    out = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(dict(rows.dtypes)["vec_id"])
    if not seeds:
        return spark.createDataFrame([], out)
    centroids = np.array([r["q"] for r in seeds], np.int64)
    sample = rows.orderBy(F.xxhash64("vec_id"), "q").limit(SAMPLE).collect()
    simplex = Simplex(pivots_of(np.array([r["q"] for r in sample], np.int64)))
    cached = cut(with_apexes(rows, simplex))
    for _ in range(rounds):
        new = moved(cached, centroids, simplex)
        if (new == centroids).all():
            break
        centroids = new
    tops = simplex.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, apexes = matrix(b.column(1)).astype(np.int64), matrix(b.column(2))
            for at in range(0, len(q), ROWS_AT_ONCE):
                part = q[at : at + ROWS_AT_ONCE]
                cluster = nearest(part, apexes[at : at + ROWS_AT_ONCE], centroids, tops)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(cluster.astype(np.int32)), pa.array(((part - centroids[cluster]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    assigned = cut(cached.mapInArrow(assign, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after another; d * 8 + cluster orders by distance, then number."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS cluster, q FROM v ORDER BY sha256('3:' || vec_id) NULLS LAST, q LIMIT 8)",
        "e AS MATERIALIZED (SELECT rid, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v)",
    ]
    assign = "SELECT rid, min(d * 8 + cluster) AS m FROM (SELECT rid, cluster, list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) FOR i IN range(1, 65)]) AS d FROM v, {c} c) GROUP BY rid"
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(c=f'c{r}')})")
        steps.append(f"s{r} AS (SELECT m % 8 AS cluster, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY ALL)")
        steps.append(f"m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY cluster)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)")
    steps.append(f"a AS MATERIALIZED ({assign.format(c=f'c{ROUNDS}')})")
    return (
        "WITH " + ",\n".join(steps) + "\n"
        "SELECT v.vec_id, (m % 8)::INTEGER AS cluster, (m // 8)::BIGINT AS distance, (sum(m // 8) OVER (PARTITION BY m % 8))::BIGINT AS cluster_inertia, (sum(m // 8) OVER ())::BIGINT AS inertia,\n"
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN v USING (rid) JOIN c{ROUNDS} c ON c.cluster = m % 8"
    )


OP11_SQL = _sql()
