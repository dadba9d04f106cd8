"""The queries of what is made to fit, on orders and their lines, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import fitting
from pagewright.plans.catalog import longs, read

STEPS = len(fitting.LADDER)


def tightened_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as gaps, some between paragraphs; customers' overflows are from 0 to 19 points and a bit."""
    key = F.col("o_orderkey")
    gaps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("i"), F.when(key % 5 == 0, 30.0).otherwise(14.0 + key % 3).alias("step"), F.lit(14.0).alias("lead"))
    needs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 20 + 0.1370713).cast("double").alias("overflow"))
    return fitting.tightened(gaps, needs).select("doc", "i", F.round("less", 3).alias("less"), F.round("up", 3).alias("up"))


def image_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as images of their orders, as large as their price; a step takes off a twentieth, more or less by the line."""
    price = F.round("l_extendedprice").cast("long")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda s: price - F.floor(price * (s + F.col("l_linenumber") % 3) / 20).cast("long"))
    images = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("image"), price.alias("size"), sizes.alias("sizes"))
    rest = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 5000).alias("other"), F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 9) / 10).cast("long").alias("target"))
    return longs(fitting.smallest_enough(images, rest, "balanced"))


def glyph_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as a line of glyphs from 0 to 4; runs of falling length are known."""
    key = F.col("o_orderkey")
    i = F.row_number().over(fitting.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    glyphs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), i.alias("i"), F.when(key % 23 == 0, "F2").otherwise("F1").alias("font"), (key % 5).alias("glyph"), (key % 3 == 0).alias("sure"), (key % 17 == 0).alias("space"))
    known = spark.createDataFrame([(f, k, t, c) for f in ("F1", "F2") for k, t, c in KNOWN], "font string, key string, text string, conflict boolean")
    return longs(fitting.longest_readings(glyphs, known))


#: Readings of runs of glyphs and of single ones; the last is in conflict.
KNOWN = [("c:0,1", "ab", False), ("c:1,2,3", "bcd", False), ("c:3,4", "de", False), ("c:4,0,1", "eab", False), ("c:2,2", "cc", False), ("g:2", "c", False), ("g:0", "a", False), ("g:4", "e", True)]
QUERIES = {"tightened_gaps": tightened_gaps, "image_steps": image_steps, "glyph_readings": glyph_readings}
_LADDER = ", ".join(f"({i}, {d}, {q})" for i, (d, q) in enumerate(fitting.LADDER) if d <= fitting.STARTS["balanced"])
_KNOWN = ", ".join(f"('{k[2:]}', {k.count(',') + 1}, '{t}')" for k, t, c in KNOWN if not c)
ORACLE_SQL = {
    "tightened_gaps": """
WITH g AS (SELECT o_custkey AS doc, o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 THEN 30.0::DOUBLE ELSE 14 + o_orderkey % 3 END AS step FROM orders),
s AS (SELECT *, 0.1::DOUBLE * step AS cap, step > 17.5 AS part, doc % 20 + 0.1370713::DOUBLE + 0.5::DOUBLE AS need FROM g WHERE doc IN (SELECT c_custkey FROM customer)),
t AS (SELECT *, coalesce(sum(cap) FILTER (part) OVER d, 0) AS p, coalesce(sum(cap) FILTER (NOT part) OVER d, 0) AS l FROM s WINDOW d AS (PARTITION BY doc)),
r AS (SELECT *, CASE WHEN p + l >= need THEN floor(1000 * CASE WHEN part THEN cap * CASE WHEN p >= need THEN need / p ELSE 1 END WHEN p >= need THEN 0 ELSE cap * least(1, (need - p) / l) END + 0.5) / 1000 END AS less FROM t)
SELECT doc, i, round(less, 3) AS less, round(sum(less) OVER (PARTITION BY doc ORDER BY i), 3) AS up FROM r
""",
    "image_steps": f"""
WITH ladder(step, dpi, quality) AS (VALUES {_LADDER}), im AS (SELECT l_orderkey AS doc, l_linenumber AS k, round(l_extendedprice)::BIGINT AS size FROM lineitem),
d AS (SELECT o_orderkey AS doc, o_orderkey % 5000 AS other, round(o_totalprice * (o_orderkey % 9) / 10)::BIGINT AS target FROM orders),
n AS (SELECT doc, step, dpi, quality, size, size - floor(size * (step + k % 3) / 20)::BIGINT AS new FROM im, ladder),
t AS (SELECT n.doc, step, dpi, quality, sum(CASE WHEN new < 0.92::DOUBLE * size THEN new ELSE size END) + any_value(other) AS bytes, sum(size) + any_value(other) AS lossless, any_value(target) AS target FROM n JOIN d ON d.doc = n.doc GROUP BY ALL),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc ORDER BY bytes > target, CASE WHEN bytes <= target THEN step ELSE bytes END, step) = 1),
u AS (SELECT *, lossless > target AND bytes < lossless AS used FROM b)
SELECT doc, CASE WHEN used THEN step END::BIGINT AS step, CASE WHEN used THEN dpi END::BIGINT AS dpi, CASE WHEN used THEN quality END::DOUBLE AS quality, CASE WHEN used THEN bytes ELSE lossless END::BIGINT AS bytes, CASE WHEN used THEN bytes ELSE lossless END <= target AS reached FROM u
UNION ALL SELECT doc, NULL, NULL, NULL, other, other <= target FROM d WHERE doc NOT IN (SELECT doc FROM im)
""",
    "glyph_readings": f"""
WITH RECURSIVE g AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 23 = 0 THEN 2 ELSE 1 END AS font, o_orderkey % 5 AS glyph, o_orderkey % 3 = 0 AS sure, o_orderkey % 17 = 0 AS space FROM orders),
known(key, n, text) AS (VALUES {_KNOWN}),
runs AS (SELECT a.line, a.i, n, string_agg(b.glyph, ',' ORDER BY b.i) AS key FROM g a JOIN (SELECT DISTINCT n FROM known) k ON true JOIN g b ON b.line = a.line AND b.i BETWEEN a.i AND a.i + n - 1
  GROUP BY a.line, a.i, a.font, n HAVING count(*) = n AND bool_and(NOT b.space AND b.font = a.font) AND NOT bool_and(b.sure)),
best AS (SELECT line, i, max(r.n) AS n, arg_max(text, r.n) AS text FROM runs r JOIN known k ON k.key = r.key AND k.n = r.n GROUP BY line, i),
walk AS (SELECT line, -1::BIGINT AS i, 0::BIGINT AS n, NULL::VARCHAR AS text, 0::BIGINT AS free FROM (SELECT DISTINCT line FROM best) UNION ALL
  SELECT w.line, b.i, b.n, b.text, b.i + b.n FROM walk w JOIN best b ON b.line = w.line AND b.i = (SELECT min(x.i) FROM best x WHERE x.line = w.line AND x.i >= w.free))
SELECT line, i, n, text FROM walk WHERE i >= 0
""",
}
