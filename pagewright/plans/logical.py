"""The query of logical lines, on parts as rows of pages with a sidebar or a table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import logical, reading
from pagewright.plans.catalog import longs, read


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts a page: a title, 19 rows on the left and 20 on the right, on the same baselines; on every third page those on the right are dates, so that it is a table."""
    k = F.col("p_partkey")
    page, n = F.floor(k / 40), k % 40
    right = (n > 0) & (n % 2 == 1)
    x0 = F.when(right, 400.0).otherwise(40.0)
    x1 = F.when(n == 0, 540.0).when(right, 480.0 + k % 3).otherwise(300.0 + k % 7)
    y = 800.0 - 14 * F.floor((n + 1) / 2) - F.when(n > 0, 20.0).otherwise(0.0)
    pieces = F.array(F.struct(x0.alias("x"), F.col("p_name").alias("text")), F.struct((x0 + 20).alias("x"), F.col("p_brand").alias("text")))
    return read(spark, sf_dir, "part").select(page.alias("page"), n.alias("row"), x0.alias("x0"), x1.alias("x1"), y.alias("y"), F.lit(10.0).alias("size"), (n % 5 == 0).alias("bold"), (right & (page % 3 == 0)).alias("dated"), pieces.alias("pieces"))


def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_rows(spark, sf_dir)
    found = logical.sidebars(rows, reading.column_gutters(rows.select("page", "x0", "x1"), 9.0), 595.0)
    out = logical.logical_lines(logical.in_columns(rows, found))
    return longs(out.select("page", "col", "line", "text", F.size("parts").alias("n_parts"), "x", "y", "bold", "gap"))


QUERIES = {"logical_lines": logical_lines}
ORACLE_SQL = {
    # the title crosses the gutter; a table's rows of one baseline are one line of column 0
    "logical_lines": r"""
WITH r AS (SELECT p_partkey // 40 AS page, p_partkey % 40 AS n, trim(regexp_replace(p_name || ' ' || p_brand, '\s+', ' ', 'g')) AS t FROM part),
p AS (SELECT *, page % 3 = 0 AS tab, n % 2 = 1 AS rgt, CASE WHEN n = 0 THEN 800.0::DOUBLE ELSE 780 - 14 * ((n + 1) // 2) END AS y FROM r),
c AS (SELECT *, CASE WHEN tab OR n = 0 THEN 0 WHEN rgt THEN 2 ELSE 1 END AS col FROM p),
l AS (SELECT page, col, y, string_agg(t, ' ' ORDER BY rgt) AS text, count(*) AS n_parts, min(CASE WHEN rgt THEN 400.0::DOUBLE ELSE 40 END) AS x, bool_and(n % 5 = 0) AS bold FROM c GROUP BY page, col, y)
SELECT page, col, row_number() OVER w - 1 AS line, text, n_parts, x, y, bold, coalesce(lag(y) OVER w - y, 99)::DOUBLE AS gap FROM l WINDOW w AS (PARTITION BY page, col ORDER BY y DESC)
""",
}
