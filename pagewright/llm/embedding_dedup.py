"""Near-duplicate embeddings by an exact metric range join (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import components, cut

COSINE = 0.95
#: Leading directions that a vector is seen in first; the length of the rest is one more coordinate.
LEADING = 16
#: Vectors of a block; a cell is compared block by block, each pair of blocks a group of its own.
BLOCK = 16_384
ROWS_AT_ONCE = 256
#: Vectors that the driver sees, at most, and bytes of them: directions, pivots and the measured replication come from them.
SAMPLE, SAMPLE_BYTES = 8192, 1 << 25
#: Numbers of pivots that are weighed against each other, and the costs that weigh them: seconds a moved copy, seconds a compared pair.
PIVOTS = (4, 16, 64, 256, 1024)
MOVED, COMPARED = 2e-5, 2e-9
#: What single precision can err in a product of LEADING + 1 coordinates of unit vectors, generously.
SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by the largest component first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def folded(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors seen in the leading directions, with the length of the rest as one more coordinate.

    Folding keeps lengths and brings no two vectors farther apart: the product of two folded vectors is their cosine or
    more, as the rests' product is at most that of their lengths (Cauchy-Schwarz).
    """
    led = units @ directions
    return np.hstack([led, np.sqrt(np.maximum(0, 1 - (led * led).sum(1, keepdims=True)))]).astype(np.float32)


def cells_of(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each folded vector, its cell, and a mask of the earlier cells that may hold a neighbour of it.

    If y is within reach of an x that is nearer to pivot c than to y's own pivot h, then y is within reach of the plane
    between them, whose distance is (d(y, c)^2 - d(y, h)^2) / (2 d(c, h)), a sharper form of the triangle inequality.
    Of two neighbours in different cells, the one of the later cell is copied to the earlier, so they meet once.
    """
    dots = points @ pivots.T
    home = dots.argmax(1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    reach = np.sqrt(2 - 2 * COSINE) + 1e-3  # single precision errs by less in a chord of this length
    gap = 2 * (dots[np.arange(len(home)), home][:, None] - dots)
    return home, (gap <= 2 * reach * between[home] + SLACK) & (np.arange(len(pivots)) < home[:, None])


def block_counts(own: np.ndarray, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each cell's own vectors and of its guests."""
    return np.maximum(1, -(-own // BLOCK)), -(-guests // BLOCK)


def chosen_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """As many pivots as cost least for n vectors, by the copies and comparisons measured on the half of the sample that holds no pivot."""
    pivots, probes = sample[: len(sample) // 2], sample[len(sample) // 2 :]
    best, least = sample[:1], float("inf")
    for m in PIVOTS:
        if m > len(pivots):
            break
        home, visits = cells_of(probes, pivots[:m])
        scale = n / len(probes)
        own, guests = np.bincount(home, minlength=m) * scale, visits.sum(0) * scale
        blocks, others = block_counts(own.astype(np.int64), guests.astype(np.int64))
        cost = MOVED * (own * (blocks + others) + guests * blocks).sum() + COMPARED * (own * (own / 2 + guests)).sum()
        if cost < least:
            best, least = pivots[:m], cost
    return best


def joined(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of the components that the links x - y join, each the smallest index in it."""
    while True:
        new = labels.copy()
        low = np.minimum(labels[x], labels[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, labels[x], low)
        np.minimum.at(new, labels[y], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def near_pairs(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a and b (unit vectors; folded: fa, fb) with a cosine of 0.95 or more: the folded product rules pairs out, the whole one decides."""
    x, y = np.nonzero(fa @ fb.T >= np.float32(COSINE - SLACK))
    if len(x) * 8 > len(a) * len(b):  # so many that one product of all is cheaper
        return np.nonzero(a @ b.T >= COSINE)
    near = np.concatenate([np.einsum("ij,ij->i", a[x[i : i + 16_384]], b[y[i : i + 16_384]]) >= COSINE for i in range(0, len(x), 16_384)]) if len(x) else np.zeros(0, bool)
    return x[near], y[near]


def block_links(pdf: pd.DataFrame, directions: np.ndarray) -> pd.DataFrame:
    """Compares the two blocks of a group, or its only block with itself: counts (rid, n, null), and links (rid, 0, other) that span the same components as all it finds."""
    out = pd.DataFrame({"rid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})
    alone = pdf["i"].iat[0] == pdf["j"].iat[0]
    right = pdf["right"].to_numpy()
    if not alone and (right.all() or not right.any()):
        return out
    pdf = pdf.iloc[np.argsort(right, kind="stable")]
    units, ids, copies = unit(stacked(pdf["embedding"])), pdf["rid"].to_numpy(), pdf["m"].to_numpy()
    points = folded(units, directions)
    n_left = len(pdf) if alone else int((~right).sum())
    labels, counts = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
    for first in range(0, n_left, ROWS_AT_ONCE):
        last = min(first + ROWS_AT_ONCE, n_left)
        start = first if alone else n_left
        x, y = near_pairs(units[first:last], units[start:], points[first:last], points[start:])
        x, y = x + first, y + start
        if alone:
            x, y = x[x < y], y[x < y]
        np.add.at(counts, x, copies[y])
        np.add.at(counts, y, copies[x])
        labels = joined(labels, x, y)
    some, moved = counts > 0, labels != np.arange(len(pdf))
    return pd.concat([out, pd.DataFrame({"rid": ids[some], "n": counts[some], "other": pd.Series([pd.NA] * int(some.sum()), dtype="Int64")}), pd.DataFrame({"rid": ids[moved], "n": 0, "other": pd.Series(ids[labels[moved]], dtype="Int64")})])


def near_embeddings(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Per vector (vec_id, embedding): n_links, component_id, kept; vectors link at a cosine of 0.95 or more.

    Equal vectors become one with a count. Distances are chords between unit vectors, a metric; 0.95 is one distance.
    Vectors are folded into their LEADING directions and the length of the rest, which shortens distances only: cells and
    copies are decided there. A vector lives in the cell of its nearest pivot and is copied to the earlier cells whose
    boundary is within reach. Cells join independently, in blocks: own against own and own against guests, so each
    pair of neighbours meets in one group. A group tests pairs in the folded coordinates first and by all components
    then. No pairs are emitted: counts and a spanning forest of each group.

    The number of pivots is the one of PIVOTS that costs least, as measured on the sample. The driver sees the sample
    (SAMPLE vectors, SAMPLE_BYTES) and counts per cell. Where vectors don't cluster, distances in many dimensions differ
    little and pivots rule out little: the comparisons, cheap as they are, then grow with the square of the vectors.

    Null, zero and non-finite vectors, and those with a null component, link with nothing; vectors of other lengths are
    compared among themselves. A null vec_id is kept as it is; equal rows each have their row; other columns are left out.
    """
    if threshold != COSINE:
        raise ValueError("the links are built for a cosine of 0.95")
    fit = F.coalesce(F.forall("embedding", lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", fit.alias("fit"), F.xxhash64(F.lit("a"), "embedding").alias("k1"), F.xxhash64(F.lit("b"), "embedding").alias("k2"))
    reps = rows.where("fit").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    reps = cut(reps.withColumn("rid", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    sizes = reps.groupBy("dims").count().collect()  # lengths of vectors, few
    found = None
    for dims, n in [(r["dims"], r["count"]) for r in sizes]:
        part = links_of(reps.where(F.col("dims") == dims).select("rid", "m", "embedding", "k1", "k2"), dims, n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = reps.select("rid", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("other"))
    found = cut(found)
    counts = found.where("other is null").groupBy("rid").agg(F.sum("n").alias("n"))
    linked = components(found.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    labels = reps.select("k1", "k2", "rid", "m", "least").join(counts, "rid", "left").join(linked.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(least, "root").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "fit", "k1", "k2").join(labels, ["k1", "k2"], "left")
    component = F.coalesce(F.when(F.col("fit"), F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.when(F.col("fit"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def links_of(reps: DataFrame, dims: int, n: int) -> DataFrame:
    """Counts (rid, n, null) and links (rid, 0, other) that span the components of n distinct vectors of one length, group by group."""
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = unit(np.array([r["embedding"] for r in reps.orderBy("k1", "k2").limit(most).select("embedding").collect()], np.float64))
    directions = np.ascontiguousarray(np.linalg.svd(sample, full_matrices=False)[2][:LEADING].T)
    pivots = chosen_pivots(folded(sample, directions), n)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            home, visits = cells_of(folded(unit(stacked(pdf["embedding"])), directions), pivots)
            yield pd.DataFrame({"cell": np.arange(len(pivots)), "own": np.bincount(home, minlength=len(pivots)), "guests": visits.sum(0)})

    per_cell = reps.select("embedding").mapInPandas(count, "cell int, own long, guests long").groupBy("cell").agg(F.sum("own"), F.sum("guests")).collect()
    sizes = np.zeros((2, len(pivots)), np.int64)
    for cell, own, guests in per_cell:
        sizes[:, cell] = own, guests
    blocks, others = block_counts(*sizes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies each vector to its groups (cell, i, j): i is a block of the cell's own vectors, j one of those from i on or, numbered after them, of guests; right: the vector is of block j."""
        for whole in batches:
            for first in range(0, len(whole), 1000):
                pdf = whole.iloc[first : first + 1000]
                home, visits = cells_of(folded(unit(stacked(pdf["embedding"])), directions), pivots)
                spread = (pdf["rid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                parts = []
                for guests, (row, cell) in ((False, (np.arange(len(pdf)), home)), (True, np.nonzero(visits))):
                    copies = blocks[cell] + (0 if guests else others[cell])
                    k = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                    at = blocks[cell] + spread[row] % others[cell] if guests else spread[row] % blocks[cell]
                    pair = (k, at) if guests else (np.where(k < blocks[cell], np.minimum(at, k), at), np.maximum(at, k))
                    parts.append(pd.DataFrame({"cell": cell, "i": pair[0], "j": pair[1], "right": k < at, "row": row}))
                out = pd.concat(parts)
                taken = pdf.iloc[out.pop("row").to_numpy()].reset_index(drop=True)
                yield pd.concat([out.reset_index(drop=True), taken[["rid", "m", "embedding"]]], axis=1)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return block_links(pdf, directions)

    kind = dict(reps.dtypes)["embedding"]
    dealt = reps.select("rid", "m", "embedding").mapInPandas(deal, f"cell int, i int, j int, right boolean, rid long, m long, embedding {kind}")
    return dealt.groupBy("cell", "i", "j").applyInPandas(compare, "rid long, n long, other long")


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE list_sum([x * x FOR x IN e]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT l.a AS vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.a = l.component_id AS kept FROM least l LEFT JOIN counts c ON c.a = l.a
"""
