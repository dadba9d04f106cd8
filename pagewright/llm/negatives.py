"""Hard negatives of embeddings by exact inner-product search with coordinate pruning (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.clustering import finite, matrix
from pagewright.llm.common import cut, partitions

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is between so many hundredths of the positive's.
LEAST, MOST = 30, 90
#: Vectors of a length bucket, and coordinates of an anchor that prune it.
BUCKET, FOCUS = 4096, 3
#: Anchors that a task holds at once; vectors of a lane, the stream that a task reads, at least and at most.
BLOCK, LANE, LONG_LANE = 4096, 4096, 1_000_000
#: Vectors that give each anchor a first threshold, which only makes the search faster.
SAMPLE = 1024
#: Where the feasible ranges leave more than this share of a bucket, the whole bucket is one product.
DENSE = 0.1
#: What double precision can err in a cosine, generously.
SLACK = 1e-9
FIELDS = "a long, p long, none boolean, vec_id long, label long, rid long, score long"
#: Of rows found: score, negated; whether the id is null; id, label and number: they sort as wanted.
SCORE, NONE, ID, LABEL, RID = range(5)


def integer_rows(vectors: DataFrame, scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """(rid, vec_id, label, dims, length, q) of the rows with a label, a vector and finite components only; q is floor(scale * component), rid a number of the row.

    Components are small enough that products of two rows fit 62 bits; else there is an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("embedding", lambda x: F.pow(x.cast("double") * scale, 2) * F.size("embedding") < 2.0**60)
    q = F.when(small, scaled).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("array<bigint>"))
    rows = rows.select("vec_id", "label", F.size("embedding").alias("dims"), q.alias("q"))
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "dims", length.alias("length"), "q"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b: in doubles where they are whole numbers there, else in 64-bit integers."""
    if np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The first `most` of the rows shown, by score (highest first), id (null last), label and number."""

    def __init__(self, most: int) -> None:
        self.most, self.rows = most, np.zeros((0, 5), np.int64)

    def add(self, rows: np.ndarray) -> None:
        rows = np.vstack([self.rows, rows])
        self.rows = rows[np.lexsort(rows.T[::-1])[: self.most]]

    def floor(self, least: float) -> float:
        """What a score must reach to be wanted."""
        return max(least, -self.rows[-1, SCORE]) if len(self.rows) == self.most else least


class Search:
    """The searches of one anchor: one for its positives, or one for the negatives of each of its positives.

    A search wants the first `most` rows in a window of scores, of the anchor's label or of others.
    """

    def __init__(self, rid: int, label: int, positives: list[tuple[int, int]] | None, sample: np.ndarray) -> None:
        self.rid, self.label, self.same = rid, label, positives is None
        windows = [(None, -np.inf, np.inf)] if positives is None else [(p, -(-LEAST * s // 100), MOST * s // 100) for p, s in positives]
        self.wanted = [[p, low, high, Best(POSITIVES if self.same else NEGATIVES)] for p, low, high in windows if low <= high]
        fit = sample[((sample[:, LABEL] == label) == self.same) & (sample[:, RID] != rid)]
        for w in self.wanted:
            near = np.sort(-fit[(-fit[:, SCORE] >= w[1]) & (-fit[:, SCORE] <= w[2]), SCORE])[::-1]
            if len(near) >= w[3].most:
                w[1] = max(w[1], near[w[3].most - 1])
        self.update()

    def update(self) -> None:
        self.least = min((best.floor(low) for _, low, _, best in self.wanted), default=np.inf)

    def show(self, rows: np.ndarray) -> None:
        rows = rows[((rows[:, LABEL] == self.label) == self.same) & (rows[:, RID] != self.rid)]
        for _, low, high, best in self.wanted:
            fit = rows[(-rows[:, SCORE] >= best.floor(low)) & (-rows[:, SCORE] <= high)]
            if len(fit):
                best.add(fit)
        self.update()


def feasible(q: np.ndarray, lengths: np.ndarray, least: np.ndarray, long: float, short: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The focus coordinates of each anchor (its largest), and the range of each that a vector of the bucket must have, scaled to length 1, to score `least`.

    The angle of two vectors is at most that of the least cosine, so the angles of both with an axis differ by no more.
    """
    focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :FOCUS]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, least / (lengths * long), least / (lengths * short))
        own = np.take_along_axis(q, focus, 1) / lengths[:, None]
    turn = np.arccos(np.clip(np.nan_to_num(cosine, nan=-1.0) - SLACK, -1, 1))[:, None]  # of a zero anchor or vector: anything goes
    angle = np.arccos(np.clip(np.nan_to_num(own), -1, 1))
    low, high = np.cos(np.minimum(np.pi, angle + turn)) - SLACK, np.cos(np.maximum(0, angle - turn)) + SLACK
    free = (turn >= np.pi) | (lengths[:, None] == 0)
    return focus, np.where(free, -np.inf, low), np.where(free, np.inf, high)


def bucket(searches: list[Search], q: np.ndarray, lengths: np.ndarray, p: np.ndarray, p_lengths: np.ndarray, info: np.ndarray) -> bool:
    """Shows the bucket's vectors p, longest first, to the searches that they can matter to; False if no later, shorter bucket can matter to any."""
    least = np.array([s.least for s in searches])
    live = np.flatnonzero((least <= 0) & (least > -np.inf) | (least == -np.inf) | (least <= lengths * p_lengths[0] * (1 + SLACK)))
    if not len(live):
        return False
    focus, low, high = feasible(q[live], lengths[live], least[live], p_lengths[0], p_lengths[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        units = np.nan_to_num(p / p_lengths[:, None])
    order = np.argsort(units, axis=0, kind="stable")
    first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for c in np.unique(focus):
        at = focus == c
        values = units[order[:, c], c]
        first[at], last[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
    short = (last - first).argmin(1) if focus.shape[1] else np.zeros(len(live), int)
    counts = (last - first).min(1, initial=len(p))
    dense = counts > DENSE * len(p)

    def show(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= searches[i].least
        if keep.any():
            searches[i].show(np.column_stack([-scores[keep], info[rows[keep]]]))

    if dense.any():
        scores = products(q[live[dense]], p)
        for i, row in zip(live[dense], scores, strict=True):
            show(i, np.arange(len(p)), row)
    for k in np.flatnonzero(~dense & (counts > 0)):
        rows = order[first[k, short[k]] : last[k, short[k]], focus[k, short[k]]]
        values = units[np.ix_(rows, focus[k])]
        rows = rows[((values >= low[k]) & (values <= high[k])).all(1)]
        show(live[k], rows, products(q[live[k] : live[k] + 1], p[rows])[0])
    return True


def lane(sample: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: of each key first the anchors come, then its vectors by falling length."""

    def found(searches: list[Search]) -> pa.RecordBatch:
        parts = [(s.rid, p, best.rows) for s in searches for p, _, _, best in s.wanted if len(best.rows)]
        rows = np.vstack([np.zeros((0, 5), np.int64), *[r for *_, r in parts]])
        sizes = [len(r) for *_, r in parts]
        a = np.repeat(np.array([x for x, _, _ in parts], np.int64), sizes)
        p = pa.array(np.repeat(np.array([-1 if x is None else x for _, x, _ in parts], np.int64), sizes))
        return pa.RecordBatch.from_arrays([pa.array(a), p, pa.array(rows[:, NONE] > 0), pa.array(rows[:, ID]), pa.array(rows[:, LABEL]), pa.array(rows[:, RID]), pa.array(-rows[:, SCORE])], ["a", "p", "none", "vec_id", "label", "rid", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, searches, q, lengths, more = None, [], None, None, None, True
        for b in batches:
            keys = np.column_stack([b.column(n).to_numpy() for n in ("dims", "block", "lane", "probe")])
            cuts = np.flatnonzero((np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0).any(1))
            for start, end in zip(cuts, [*cuts[1:], len(b)], strict=True):
                part, now = b.slice(start, end - start), tuple(keys[start])
                if now[:3] != key:
                    if searches:
                        yield found(searches)
                    key, anchors, searches, more = now[:3], [], None, True
                if not now[3]:
                    anchors.append(part)
                    continue
                if searches is None:
                    q, lengths, searches = started(anchors, int(now[0]), sample)
                if not searches or not more:
                    continue
                p, sizes, info = read(part)
                for at in range(0, len(p), BUCKET):
                    more = more and bucket(searches, q, lengths, p[at : at + BUCKET], sizes[at : at + BUCKET], info[at : at + BUCKET])
        if searches:
            yield found(searches)

    return work


def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, lengths and what names the rows: null, id, label, number."""
    ids = b.column("vec_id")
    q = matrix(b.column("q")) if len(b.column("q").flatten()) else np.zeros((len(b), 0), np.int64)
    return q, b.column("length").to_numpy(), np.column_stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), b.column("label").to_numpy(), b.column("rid").to_numpy()])


def started(anchors: list[pa.RecordBatch], dims: int, sample: dict) -> tuple[np.ndarray, np.ndarray, list[Search]]:
    if not anchors:
        return np.zeros((0, dims), np.int64), np.zeros(0), []
    table = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
    q, lengths, info = read(table)
    positives = [None if w is None else [(x["p"], x["score"]) for x in w] for w in table.column("positives").to_pylist()]
    s_q, s_info = sample.get(dims, (np.zeros((0, dims), np.int64), np.zeros((0, 4), np.int64)))
    scores = products(q, s_q)
    return q, lengths, [Search(int(i[3]), int(i[2]), w, np.column_stack([-row, s_info])) for i, w, row in zip(info, positives, scores, strict=True)]


def searched(anchors: DataFrame, rows: DataFrame, n: int, n_anchors: int, sample: dict) -> DataFrame:
    """FIELDS of what the anchors' searches find in each lane; anchors are rows with `positives`, null to look for positives.

    Anchors go in blocks of about BLOCK to every lane of rows; a lane is a stream sorted by length, read bucket by
    bucket, with thresholds that rise as it goes.
    """
    blocks = max(1, -(-n_anchors // BLOCK))
    lanes = max(-(-n // LONG_LANE), min(-(-n // LANE), partitions(rows.sparkSession)), 1)
    shape = ["rid", "vec_id", "label", "dims", "length", "q", "positives"]
    left = anchors.select(*shape, F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("probe"))
    kind = dict(anchors.dtypes)["positives"]
    right = rows.withColumn("positives", F.lit(None).cast(kind)).select(*shape, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(F.lit(7), "rid"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("probe"))
    dealt = left.unionByName(right).repartition(2 * lanes * blocks, "dims", "block", "lane").sortWithinPartitions("dims", "block", "lane", "probe", F.col("length").desc())
    return dealt.mapInArrow(lane(sample), FIELDS)


def first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "none", "vec_id", "label", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Rows for which `anchor` holds are anchors; `label` replaces the label. Scores are inner products of floor(256 * x) in
    exact integers; higher ones come first, ties by the smaller vec_id (null last), then label. An anchor's positives are
    its first 5 other rows of its label; a positive's negatives are the first 10 rows of other labels with
    30 * positive <= 100 * score <= 90 * positive. Fewer are all there are; a positive without negatives gives no row.

    The search is exact, after LEMP: vectors stream by falling length in buckets; a bucket too short for an anchor's
    threshold ends its search; within one, the ranges that the anchor's focus coordinates can have are looked up in sorted
    coordinate lists, their sets intersect, and what is left is verified. Where ranges leave much of a bucket (vectors
    without large coordinates), the bucket is one product. The anchors, a stated query set, meet all rows in blocks: the
    work grows with both, the memory of a task with neither.

    Rows with a null label, a null vector or a null or non-finite component take no part. A null vec_id is never divisible
    and can be a positive or negative. Repeated rows are rows of their own: each may be a positive of the other. Vectors
    meet those with as many components only. An empty table gives no rows. Other columns are left out.
    """
    rows = integer_rows(vectors, label=label)
    n = rows.count()
    anchors = rows.where(F.coalesce(anchor, F.lit(False)))
    n_anchors = anchors.count()
    sample = {}
    for d in {r["dims"] for r in rows.select("dims").distinct().collect()}:  # lengths of vectors, few
        b = rows.where(F.col("dims") == d).orderBy(F.xxhash64(F.lit(3), "rid")).limit(SAMPLE).toArrow().combine_chunks().to_batches()[0]
        q, _, info = read(b)
        sample[d] = (q, info)
    none = F.lit(None).cast("array<struct<p:bigint,score:bigint>>")
    positives = cut(first(searched(anchors.withColumn("positives", none), rows, n, n_anchors, sample), ["a"], POSITIVES))
    given = positives.groupBy("a").agg(F.collect_list(F.struct(F.col("rid").alias("p"), "score")).alias("positives"))  # POSITIVES at most
    again = anchors.join(given.withColumnRenamed("a", "rid"), "rid")
    negatives = first(searched(again, rows, n, n_anchors, sample), ["a", "p"], NEGATIVES)
    id_ = F.when(~F.col("none"), F.col("vec_id"))
    named = positives.join(anchors.select(F.col("rid").alias("a"), F.col("vec_id").alias("anchor_id")), "a").select("a", F.col("rid").alias("p"), "anchor_id", id_.alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.select("a", "p", F.col("rank").cast("int").alias("rank"), id_.alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["a", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid, b.vec_id, b.label, a.label = b.label AS same, coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]), 0) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, label, rid) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.label, s.rid) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score FROM n WHERE rank <= 10
"""
