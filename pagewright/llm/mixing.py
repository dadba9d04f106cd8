"""Mixing sources to target weights along a training run (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import ranged, space_words, whole_row_key

#: Weights of the sources in code-point order, repeating, and how each weight's intensity runs over the training
#: positions 0 to 1: knots at equal distances, linear between them.
WEIGHTS = (3, 1, 2)
CURRICULUM = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: str = "text") -> Column:
    return F.size(space_words(F.col(text))).cast("long")


def inverse_demand(u: Column, knots: Sequence[float]) -> Column:
    """The position t in 0 to 1 by which a share u of the demand has arisen, for an intensity linear between the knots."""
    step = 1 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    out, done = None, 0.0
    wanted = u * float(sum(areas))
    for i, (a, b, area) in enumerate(zip(knots, knots[1:], areas, strict=False)):
        rest = wanted - float(done)
        # a x + (b - a) / (2 step) x^2 = rest, in the form that also holds for a = b
        x = F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(float(a)) + F.sqrt(F.greatest(F.lit(0.0), float(a * a) + rest * float(2 * (b - a) / step)))))
        here = F.lit(float(i * step)) + x
        out = here if out is None else F.when(wanted <= float(done), out).otherwise(here)
        done += area
    return F.least(F.lit(1.0), out)


def targets(cells: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: size, weight and target. cells: partial sizes (_none, _source, size).

    Sources by code point, null last, take the weights in turn. A target is the source's share by weight of `share`
    times all sizes; it stops at cap times its size, and the excess is shared again until none is above: with sources
    sorted by size / weight, those that stop are a prefix, so running sums give the level. One row per source is sorted.
    """
    every = Window.partitionBy(F.lit(1))
    by_name, by_ratio = every.orderBy("_none", "_source"), every.orderBy("ratio", "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = cells.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("at", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = out.withColumn("stops", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", "at", "level"))).over(every)["level"]
    return out.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(level * F.col("weight"))).select("_none", "_source", "at", "source_size", "target")


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0, curriculum=CURRICULUM) -> DataFrame:
    """A training plan from (doc_id, source, size, _k1, _k2): adds source_size, target, taken and positions, and sorts by the first position.

    Within a source, documents follow the md5 of their id (then row key), so reruns agree. A source's word
    budget is its target rounded; it is dealt in whole passes over the source and then a partial pass whose last
    document is cut where the budget ends. A copy stands where the demand integral of its source reaches the words
    dealt before it, plus half its own; rows come range-sorted by the first copy's position, those not taken last.

    Running sums over a source of any share of the rows are in two steps: ranges of about ROWS_A_RANGE rows, and within
    a range; no task holds a source, nor all rows of one id. Null ids sort as ''; a null source is a source, the last;
    empty tables give no rows; equal rows each have their place.
    """
    rows = sized.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("_o", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col(c) for c in ("_o", "_k1", "_k2")]
    rows = ranged(rows, F.col("_none"), F.col("_source"), *order)
    cells = rows.groupBy("_none", "_source", "_cell").agg(F.sum("size").alias("size"))
    by_cell = Window.partitionBy("_none", "_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_first", F.coalesce(F.sum("size").over(by_cell), F.lit(0))).drop("size")
    starts = starts.join(targets(cells, weights, share, cap), ["_none", "_source"])
    inside = Window.partitionBy("_none", "_source", "_cell").orderBy(*order, "_t").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, ["_none", "_source", "_cell"])
    out = out.withColumn("_start", F.col("_first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.withColumn("_budget", F.floor(F.col("target") + 0.5).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_passes", passes)
    out = out.withColumn("_part", F.greatest(F.lit(0), F.least("size", F.col("_budget") - F.col("_passes") * F.col("source_size") - F.col("_start"))))
    out = out.withColumn("taken", (F.col("_passes") * F.col("size") + F.col("_part")).cast("long"))

    def position(copy: Column) -> Column:
        take = F.when(copy < F.col("_passes"), F.col("size")).otherwise(F.col("_part"))
        u = (copy * F.col("source_size") + F.col("_start") + take / 2) / F.col("_budget")
        out = F.lit(None).cast("double")
        for i, knots in enumerate(curriculum):
            out = F.when(F.col("at") % len(curriculum) == i, inverse_demand(u, knots)).otherwise(out)
        return out

    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0).cast("long"), F.col("_passes") - F.when(F.col("_part") > 0, 0).otherwise(1)))
    out = out.withColumn("positions", F.coalesce(F.transform(copies, position), F.array().cast("array<double>")))
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions", F.col("_part").alias("part"), F.col("_passes").alias("passes"), "_k1", "_k2", "_o")
    # the documents that aren't taken share one position, the last: the md5 of the id tells them apart, so they fill many ranges
    order = [F.col("position").asc_nulls_last(), F.col("_o")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("_o")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count().alias("size"), *whole_row_key(docs.select("doc_id", "source", "text")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "position")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(nth % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM by_source),
levels AS (
  SELECT *, most / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, nth, source_size, CASE WHEN ratio <= level THEN most ELSE weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.nth, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed),
parts AS (SELECT *, greatest(0, least(size, budget - passes * source_size - start)) AS part FROM dealt),
shares AS (SELECT *, passes * size + part AS taken, (start + (CASE WHEN passes > 0 THEN size ELSE part END)::DOUBLE / 2) / budget AS u FROM parts),
knots AS (SELECT *, CASE nth % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.5 END AS a, CASE nth % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 1.5 END AS c,
  CASE nth % 3 WHEN 0 THEN 0.625::DOUBLE WHEN 1 THEN 0.5 ELSE 0.375 END AS half FROM shares)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN least(1.0::DOUBLE, CASE WHEN u <= half
    THEN 2 * u / (a + sqrt(a * a + u * 4 * (1.0::DOUBLE - a)))
    ELSE 0.5::DOUBLE + 2 * (u - half) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + (u - half) * 4 * (c - 1.0::DOUBLE))) END) END AS position
FROM knots
"""
