"""The queries of reading order and paragraphs, on documents' lines as rows of a page, and the SQL that walks them row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import paragraphs as operators
from pagewright.plans.catalog import LINES, dealt_lines, longs, read

#: What marks an item at the start of a line.
MARK = "^[-*•a-e][ )]"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that aren't blank as rows: 7 points a character, 14 a line and 10 more after each ninth, every eleventh bold, every thirteenth larger."""
    bare = F.btrim("text")
    line = dealt_lines(spark, sf_dir).where(bare != "")
    x0 = 40 + 7.0 * (F.length("text") - F.length(F.ltrim("text")) + F.col("line_no") % 17 % 2)
    mark = F.when(bare.rlike(MARK), F.concat(F.substring(bare, 1, 1), F.lit("@"), F.round(x0).cast("int").cast("string")))
    return line.select(
        F.col("doc_id").alias("page"), F.lit(0).alias("col"), F.col("line_no").cast("long").alias("row"), x0.alias("x0"), (x0 + 7 * F.length(bare)).alias("x1"), (x0 + F.when(mark.isNotNull(), 14.0).otherwise(0.0)).alias("text_x"),
        F.lit(None).cast("double").alias("label_x"), (842.0 - 14 * F.col("line_no") - 10 * F.floor(F.col("line_no") / 9)).alias("y"), F.when(F.col("line_no") % 13 == 0, 12.0).otherwise(10.0).alias("size"),
        bare.alias("text"), (F.col("line_no") % 11 == 0).alias("bold"), (F.col("line_no") % 11 == 0).alias("last_bold"), mark.alias("mark"), F.lit(14.0).alias("lead"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(operators.paragraphs(rows(spark, sf_dir)).select("page", "row", "first", "last", "kind"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts a page: a title across it, two columns of ten rows, white space, and two columns again."""
    k = F.col("p_partkey")
    n = k % 40
    x0 = F.when((n > 0) & (n % 2 == 0), 320.0).otherwise(40.0)
    y = 800.0 - 14 * F.floor((n + 1) / 2) - F.when(n > 20, 100.0).otherwise(0.0)
    r = read(spark, sf_dir, "part").select(F.floor(k / 40).alias("page"), F.col("p_partkey").alias("row"), x0.alias("x0"), (x0 + F.when(n == 0, 480.0).otherwise(200.0 + k % 7)).alias("x1"), y.alias("y"), F.lit(10.0).alias("size"))
    return operators.reading_order(r, 8.0).select("page", "row", "rank")


QUERIES = {"paragraphs": paragraphs, "reading_order": reading_order}
ORACLE_SQL = {
    "reading_order": """SELECT p_partkey // 40 AS page, p_partkey AS row, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey % 40 > 20, CASE WHEN p_partkey % 40 > 0 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END, p_partkey) - 1 AS rank FROM part""",
    "paragraphs": rf"""
WITH RECURSIVE {LINES}, r0 AS (SELECT doc_id AS page, line_no::BIGINT AS row, text AS raw, trim(text, ' ') AS text FROM lines WHERE trim(text, ' ') <> ''),
r1 AS (SELECT page, row, text, 40 + 7 * (length(raw) - length(ltrim(raw, ' ')) + row % 17 % 2)::DOUBLE AS x0, length(text) AS n, 842.0::DOUBLE - 14 * row - 10 * (row // 9) AS y, CASE WHEN row % 13 = 0 THEN 12.0::DOUBLE ELSE 10 END AS size, row % 11 = 0 AS bold, regexp_matches(text, '{MARK}') AS marked FROM r0),
r2 AS (SELECT *, x0 + 7 * n AS x1, x0 + CASE WHEN marked THEN 14 ELSE 0 END AS tx, CASE WHEN marked THEN left(text, 1) || '@' || round(x0)::INT END AS mark, row_number() OVER (PARTITION BY page ORDER BY y DESC, x0, row) - 1 AS i FROM r1),
r AS MATERIALIZED (SELECT *, max(x1) OVER (PARTITION BY page, size) AS far, lag(y) OVER o - y AS step, lag(x1) OVER o AS ax1, coalesce(regexp_matches(lag(text) OVER o, '(?i)(,|;|-|–|&|\band|\bor|\bof|\bthe|\bwith|\bfor|\bto|\bin)\s*$'), false) AS aopen,
  lag(x1) OVER o + 0.28 * size + (x1 - x0) / greatest(1, n) * length(regexp_extract(text, '^\S+')) AS fits, regexp_matches(text, '^[A-Z]') AS cap FROM r2 WINDOW o AS (PARTITION BY page ORDER BY i)),
pass AS (SELECT q.page, q.i, coalesce(NOT (q.marked OR q.step > 17.5 OR q.step < 7) AND q.bold = a.bold AND abs(q.size - a.size) < 0.1 * a.size AND (abs(q.x0 - a.x0) < 1.5 OR abs(q.x0 - a.tx) < 1.5) AND NOT q.fits < a.far - 0.5 AND NOT (q.cap AND q.ax1 < a.far - 2 * a.size AND NOT q.aopen), false) AS ok FROM r q LEFT JOIN r a ON a.page = q.page AND a.i = q.i - 1),
tops AS (SELECT page, i, NOT ok AS top, max(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY page ORDER BY i) AS s FROM pass),
walk AS (SELECT page, i AS s, i AS e FROM tops WHERE top UNION ALL
  SELECT w.page, w.s, q.i FROM walk w JOIN r a ON a.page = w.page AND a.i = w.s JOIN r q ON q.page = w.page AND q.i = w.e + 1
  WHERE NOT (q.marked OR q.step > 17.5 OR q.step < 7) AND q.bold = a.bold AND abs(q.size - a.size) < 0.1 * a.size AND (abs(q.x0 - a.x0) < 1.5 OR abs(q.x0 - a.tx) < 1.5) AND NOT q.fits < a.far - 0.5 AND NOT (q.cap AND q.ax1 < a.far - 2 * a.size AND NOT q.aopen)),
ends AS (SELECT page, s, max(e) AS e FROM walk GROUP BY ALL),
item AS (SELECT page, i AS s, i AS e FROM r WHERE marked UNION ALL
  SELECT t.page, t.s, q.i FROM item t JOIN r a ON a.page = t.page AND a.i = t.s JOIN r q ON q.page = t.page AND q.i = t.e + 1 WHERE NOT q.marked AND q.step <= 1.3 * 14 AND abs(q.x0 - a.tx) < 2.5 AND abs(q.size - a.size) < 0.1 * a.size),
items AS (SELECT page, s, max(e) AS e FROM item GROUP BY ALL),
near AS (SELECT t.*, a.mark, a.y, z.y AS y_end, lag(t.s) OVER o AS ps, lag(a.mark) OVER o AS pmark, lag(a.y) OVER o AS py, lead(t.s) OVER o AS ns, lead(a.mark) OVER o AS nmark, lead(a.y) OVER o AS ny
  FROM items t JOIN r a ON a.page = t.page AND a.i = t.s JOIN r z ON z.page = t.page AND z.i = t.e WINDOW o AS (PARTITION BY t.page ORDER BY t.s)),
good AS (SELECT page, s, e FROM near n WHERE e > s OR ns = e + 1 AND nmark = mark AND y_end - ny <= 2.2 * 14
  OR pmark = mark AND py - y <= greatest(2.6 * 14, (s - ps + 1) * 1.4 * 14) AND NOT EXISTS (SELECT 1 FROM r k WHERE k.page = n.page AND k.i >= n.ps AND k.i < n.s AND k.y - n.y > 2.6 * 14 * (n.s - k.i) + 1e-9))
SELECT r.page, r.row, coalesce(g.s, t.s) AS first, coalesce(g.e, greatest(r.i, x.e)) AS last, CASE WHEN g.s IS NULL THEN 'para' ELSE 'item' END AS kind
FROM r JOIN tops t ON t.page = r.page AND t.i = r.i JOIN ends x ON x.page = r.page AND x.s = t.s LEFT JOIN good g ON g.page = r.page AND r.i BETWEEN g.s AND g.e
""",
}
