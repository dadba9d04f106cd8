"""The query of the graphics state, on a content stream for each order, and the SQL that works out its boxes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import graphics
from pagewright.plans.catalog import dealt, longs, read

#: {a}, {b}, {c}: whole numbers of the row; {n}: one to seven squares.
STREAM = "q 2 0 0 {a} {b} 10 cm 0 0 100 50 re W n /Im Do q 1 0 0 1 5 {c} cm 3 w 1 2 m 9 {c} l S Q 20 30 40 {a} re f Q 0 0 7 7 re f* BT (x) Tj ET Q /Fm Do {n}"


def line_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content stream for each order, with the objects that it names."""
    key, by = F.col("o_orderkey"), F.col("o_custkey")
    line = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(key.alias("page"), (by % 5 + 1).alias("a"), (by % 9).alias("b"), (key % 30).alias("c"), F.repeat(F.lit("1 0 0 1 8 0 cm 0 0 4 4 re f "), (key % 7 + 1).cast("int")).alias("n"))
    parts = [F.col(t).cast("string") if i % 2 else F.lit(t) for i, t in enumerate(re.split(r"\{(\w)\}", STREAM))]
    objects = F.array(F.struct(F.lit("Im").alias("name"), F.lit("image").alias("kind"), F.lit(None).cast("array<double>").alias("bounds"), F.lit(None).cast("array<double>").alias("matrix")), F.struct(F.lit("Fm").alias("name"), F.lit("form").alias("kind"), graphics.numbers(0, 0, 10, 4).alias("bounds"), graphics.numbers(1, 0, 0, 2, 3, 0).alias("matrix")))
    return line.select("page", F.concat(*parts).alias("stream"), objects.alias("objects"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphics.stream_items(line_streams(spark, sf_dir))
    box = lambda c: [F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{i}") for i in range(4)]
    return longs(out.select("page", "i0", "i1", "kind", *box("box"), *box("clip_at"), "clips", "painted", F.round("line", 6).alias("line")))


QUERIES = {"page_items": page_items}
ORACLE_SQL = {
    # the first matrix is (2, 0, 0, a, b, 10); the clip is the rectangle seen by it
    "page_items": """
WITH r AS (SELECT o_orderkey AS page, (o_custkey % 5 + 1)::DOUBLE AS a, (o_custkey % 9)::DOUBLE AS b, (o_orderkey % 30)::DOUBLE AS c, o_orderkey % 7 + 1 AS n FROM orders),
w AS (SELECT *, 3 * sqrt(2 * a) AS line, [b, 10, b + 200, 10 + 50 * a] AS clip FROM r),
x AS (
  SELECT page, 2 AS i0, 4 AS i1, 'path' AS kind, clip AS box, NULL::DOUBLE[] AS clip_at, true AS clips, false AS painted, 0.0::DOUBLE AS line FROM w
  UNION ALL SELECT page, 5, 5, 'image', [b, 10, b + 2, 10 + a], clip, false, true, 0 FROM w
  UNION ALL SELECT page, 9, 11, 'path', [b + 12 - line / 2, 10 + a * (c + least(2, c)) - line / 2, b + 28 + line / 2, 10 + a * (c + greatest(2, c)) + line / 2], clip, false, true, line FROM w
  UNION ALL SELECT page, 13, 14, 'path', [b + 40, 10 + 30 * a, b + 120, 10 + a * (30 + a)], clip, false, true, 0 FROM w
  UNION ALL SELECT page, 16, 17, 'path', [0, 0, 7, 7], NULL, false, true, 0 FROM w
  UNION ALL SELECT page, 19, 19, 'text', [-1e6, -1e6, 1e6, 1e6], NULL, false, true, 0 FROM w
  UNION ALL SELECT page, 22, 22, 'form', [3, 0, 13, 8], NULL, false, true, 0 FROM w
  UNION ALL SELECT page, 21 + 3 * k, 22 + 3 * k, 'path', [8 * k, 0, 8 * k + 4, 4], NULL, false, true, 0 FROM (SELECT page, unnest(range(1, n + 1)) AS k FROM w))
SELECT page, i0::BIGINT AS i0, i1::BIGINT AS i1, kind, round(box[1], 6)::DOUBLE AS box_0, round(box[2], 6)::DOUBLE AS box_1, round(box[3], 6)::DOUBLE AS box_2, round(box[4], 6)::DOUBLE AS box_3,
  round(clip_at[1], 6)::DOUBLE AS clip_at_0, round(clip_at[2], 6)::DOUBLE AS clip_at_1, round(clip_at[3], 6)::DOUBLE AS clip_at_2, round(clip_at[4], 6)::DOUBLE AS clip_at_3, clips, painted, round(line, 6)::DOUBLE AS line FROM x
""",
}
