"""The queries of the page-reading and form operators and the SQL that checks them, on the made-up geometry of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import forms, layout, pages, reading
from pagewright.plans.catalog import ITEMS, SEGMENTS, dealt, items, longs, read

WIDTH, MIN_GAP = 595.0, 8.0
#: Words that stand for bullets.
MARK = "^[^a-z]$"


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as lines of a page, from the top down."""
    segs = layout.segments(items(spark, sf_dir))
    return segs.select("page", (F.col("line_no") * 10000 + F.col("seg_no")).cast("long").alias("id"), "x", (842 - 14.0 * F.col("line_no")).alias("y"), (F.col("x1") - F.col("x")).alias("width"), F.lit(10.0).alias("size"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.rows(placed_lines(spark, sf_dir))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select("page", (F.col("line_no") * 10000 + F.col("seq")).cast("long").alias("id"), "x", (842 - 14.0 * F.col("line_no")).alias("y"), F.lit(10.0).alias("size"), ((F.length("s") <= 2) & F.lower("s").rlike(MARK)).alias("bullet"))


def form(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A form of three fields for each customer, and answers to it and to an unknown field."""
    c = read(spark, sf_dir, "customer")
    none = F.lit(None).cast("array<string>")
    field = lambda name, kind, options, most, fixed: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), options.alias("options"), F.lit(most).cast("int").alias("max_len"), F.lit(fixed).alias("read_only"))
    kinds = F.array(field("name", "text", none, 12, False), field("rich", "checkbox", none, None, False), field("segment", "select", F.array(F.lit("BUILDING"), F.lit("MACHINERY")), None, False), field("nation", "text", none, None, True))
    said = F.array(*[F.struct(F.lit(n).alias("name"), F.array(v).alias("value")) for n, v in (("name", F.col("c_name")), ("rich", F.when(F.col("c_acctbal") > 5000, "true").otherwise("")), ("segment", F.col("c_mktsegment")), ("nope", F.lit("x")))])
    return c.select(F.col("c_custkey").alias("doc"), F.explode(kinds).alias("f")).select("doc", "f.*"), c.select(F.col("c_custkey").alias("doc"), F.explode(said).alias("a")).select("doc", "a.*")


def fill_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.filled(*form(spark, sf_dir)).select("doc", "name", "status", F.array_join("stored", ",").alias("stored"))


def form_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, answers = form(spark, sf_dir)
    return forms.counter(fields, forms.filled(fields, answers).where("status = 'filled'"))


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda k: (F.col("p_partkey") * k % 256).cast("double") / 255
    plain = scalars.hex_color(share(7), share(13), share(29))
    return dealt(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", plain.alias("plain")).select("*", scalars.readable_color(F.col("plain")).alias("readable"))


def written_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    k = F.col("o_orderkey") % 3
    start, end = F.when(k == 1, "").otherwise(month), F.when(k == 2, "").otherwise(F.date_format("o_orderdate", "yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.written_range(start, end).alias("said"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.concat("p_name", F.when(k == 0, " at ").when(k == 1, " | ").when(k == 2, ", ").otherwise(" "), "p_brand")
    out = read(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("*", scalars.split_title(F.col("said")).alias("t"))
    return out.select("p_partkey", "said", "t.title", "t.place")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn")


QUERIES = {
    "rows": lambda s, d: longs(rows(s, d)),
    "gutters": lambda s, d: reading.gutters(rows(s, d).select("page", (F.col("x0") % 300).alias("x0"), (F.col("x0") % 300 + F.least(F.lit(40.0), F.col("x1") - F.col("x0"))).alias("x1")), WIDTH, 3.0),
    "column_gutters": lambda s, d: reading.column_gutters(placed_lines(s, d).select("page", F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1")), MIN_GAP),
    "leading": lambda s, d: reading.leading(rows(s, d)),
    "bullet_targets": lambda s, d: reading.bullet_targets(marks(s, d)),
    "grid_runs": lambda s, d: longs(reading.grid_runs(layout.segments(items(s, d)))),
    "fill_form": fill_form,
    "form_counter": form_counter,
    "colors": colors,
    "written_ranges": written_ranges,
    "split_titles": titles,
    "delete_page": lambda s, d: pages.without_page(turns(s, d), 1),
    "duplicate_page": lambda s, d: pages.with_copy(turns(s, d), 1),
    "merge_pages": lambda s, d: pages.appended(turns(s, d), turns(s, d)),
    "merge_all_pages": lambda s, d: pages.appended(turns(s, d), turns(s, d)),
}

ROWS = f"""{SEGMENTS},
ends AS (SELECT *, 842 - 14.0::DOUBLE * line_no AS y, lag(x1) OVER (PARTITION BY page, line_no ORDER BY x) AS upto FROM segs),
dealt AS (SELECT *, sum(CASE WHEN upto IS NULL OR x - upto >= 22 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no, x)::BIGINT - 1 AS row FROM ends),
found AS (SELECT page, row, min(x) AS x0, max(x1) AS x1, max(y) AS y, 10.0::DOUBLE AS size, count(*) AS n_lines FROM dealt GROUP BY page, row)"""
MERGED = "SELECT conv_id, turn, turn AS new_at FROM conversations UNION ALL SELECT conv_id, turn, turn + 1 + max(turn) OVER (PARTITION BY conv_id) FROM conversations"
FORM = """c AS (SELECT c_custkey AS doc, c_name, c_acctbal > 5000 AS rich, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, c_mktsegment FROM customer)"""

ORACLE_SQL = {
    "rows": f"WITH {ROWS} SELECT * FROM found",
    "gutters": f"""WITH {ROWS}, r AS (SELECT page, x0 % 300 AS x0, x0 % 300 + least(40, x1 - x0) AS x1 FROM found),
g AS (SELECT page, x0, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM r) SELECT page, a, x0 AS b FROM g WHERE x0 - a >= 3""",
    # point by point, where the query has running sums of starts and ends
    "column_gutters": f"""WITH {SEGMENTS}, r AS (SELECT page, x AS x0, x1 FROM segs), p AS (SELECT page, floor(min(x0))::BIGINT AS o, ceil(max(x1))::BIGINT AS e, count(*) AS n FROM r GROUP BY page HAVING count(*) >= 4),
points AS (SELECT page, o, n, unnest(range(0, (e - o) * 2)) AS k FROM p),
covered AS (SELECT page, k, count(*) AS c FROM (SELECT r.page, unnest(range(floor((x0 - o) * 2)::BIGINT, ceil((x1 - o) * 2)::BIGINT)) AS k FROM r JOIN p USING (page)) GROUP BY ALL),
thin AS (SELECT t.page, o, k, coalesce(c, 0) AS c, k - row_number() OVER (PARTITION BY t.page ORDER BY k) AS strip FROM points t LEFT JOIN covered USING (page, k) WHERE coalesce(c, 0) <= floor(n * 0.08)),
cut AS (SELECT page, any_value(o) + min(k) / 2 AS a, any_value(o) + (max(k) + 1) / 2 AS b FROM (SELECT *, min(c) OVER (PARTITION BY page, strip) AS least FROM thin) WHERE c = least GROUP BY page, strip)
SELECT page, a, b, count(*) FILTER (x1 <= a + 0.5) AS n_left, count(*) FILTER (x0 >= b - 0.5) AS n_right, count(*) FILTER (x0 < a - 0.5 AND x1 > b + 0.5) AS n_cross FROM cut JOIN r USING (page) WHERE b - a >= 8 GROUP BY page, a, b HAVING n_left >= 2 AND n_right >= 2""",
    "leading": f"""WITH {ROWS}, s AS (SELECT page, lag(y) OVER (PARTITION BY page ORDER BY y DESC, x0) - y AS d FROM found), k AS (SELECT page, d, floor(d * 2 + 0.5) / 2 AS q FROM s WHERE d > 8 AND d < 30),
m AS (SELECT page, q FROM (SELECT page, q, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, q) AS r FROM k GROUP BY page, q) WHERE r = 1)
SELECT page, list_sort(list(d))[count(*) // 2 + 1]::DOUBLE AS lead FROM k JOIN m USING (page) WHERE abs(d - m.q) <= 0.5 GROUP BY page""",
    "bullet_targets": f"""WITH {ITEMS}, l AS (SELECT page, line_no * 10000 + seq AS id, x, 842 - 14 * line_no AS y, regexp_matches(lower(s), '{MARK}') AS bullet FROM items),
met AS (SELECT t.page, t.id, b.id AS b, t.y - b.y AS dy FROM l t JOIN l b ON t.page = b.page AND b.bullet AND NOT t.bullet AND t.x - b.x > 2.5 AND t.x - b.x < 30 AND abs(t.y - b.y) <= 18),
near AS (SELECT * FROM met m WHERE abs(dy) <= 1.2 OR NOT EXISTS (SELECT 1 FROM met o WHERE o.page = m.page AND o.id = m.id AND o.b <> m.b AND abs(o.dy) <= 5))
SELECT page, b AS id, arg_min(id, (abs(dy) * CASE WHEN dy > 0 THEN 1.5 ELSE 1 END, id)) AS target FROM near GROUP BY page, b""",
    "grid_runs": f"""WITH {SEGMENTS}, l AS (SELECT page, line_no, count(*) AS n, row_number() OVER (PARTITION BY page ORDER BY line_no) AS nth FROM segs GROUP BY page, line_no),
p AS (SELECT s.page, s.line_no, l.nth, l.n, s.x FROM segs s JOIN l USING (page, line_no)),
shared AS (SELECT page, line_no, nth FROM p c WHERE EXISTS (SELECT 1 FROM p q WHERE q.page = c.page AND q.nth = c.nth - 1 AND q.n >= 2 AND abs(q.x - c.x) < 5) GROUP BY page, line_no, nth HAVING count(*) >= 2),
i AS (SELECT *, nth - row_number() OVER (PARTITION BY page ORDER BY nth) AS island FROM shared)
SELECT page, line_no, row_number() OVER (PARTITION BY page, island ORDER BY nth) + 1 AS run FROM i""",
    "fill_form": f"""WITH {FORM} SELECT doc, 'name' AS name, 'filled' AS status, substr(c_name, 1, 12) AS stored FROM c UNION ALL SELECT doc, 'rich', 'filled', rich::VARCHAR FROM c
UNION ALL SELECT doc, 'segment', CASE WHEN listed THEN 'filled' ELSE 'skipped' END, CASE WHEN listed THEN c_mktsegment END FROM c UNION ALL SELECT doc, 'nope', 'skipped', NULL FROM c""",
    "form_counter": f"WITH {FORM} SELECT doc, (1 + rich::INT + listed::INT)::BIGINT AS n_filled, 3::BIGINT AS n_fields FROM c",
    "written_ranges": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k, strftime(o_orderdate, '%b %Y') AS a, strftime(o_orderdate, '%Y') AS b FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN b WHEN 2 THEN a || ' – Present' ELSE a || ' – ' || b END AS said FROM o""",
    "split_titles": """WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS n, p_name, p_brand FROM part)
SELECT p_partkey, p_name || CASE k WHEN 0 THEN ' at ' WHEN 1 THEN ' | ' WHEN 2 THEN ', ' ELSE ' ' END || p_brand AS said, CASE WHEN k = 3 THEN n || ' ' || p_brand ELSE n END AS title, CASE WHEN k = 3 THEN '' ELSE p_brand END AS place FROM t""",
    "delete_page": "WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n > 1 AND turn > 1 THEN turn - 1 ELSE turn END AS new_at FROM c WHERE n = 1 OR turn <> 1",
    "duplicate_page": "SELECT conv_id, turn, false AS is_copy, CASE WHEN turn > 1 THEN turn + 1 ELSE turn END AS new_at FROM conversations UNION ALL SELECT conv_id, turn, true, turn + 1 FROM conversations WHERE turn = 1",
    "merge_pages": MERGED,
    "merge_all_pages": MERGED,
}
LUM = "(0.2126::DOUBLE * f(r / 255) + 0.7152::DOUBLE * f(g / 255) + 0.0722::DOUBLE * f(b / 255))"
for part in ("r", "g", "b"):
    LUM = LUM.replace(f"f({part} / 255)", f"(CASE WHEN {part} / 255 <= 0.03928 THEN {part} / 255 / 12.92::DOUBLE ELSE (({part} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END)")
HEX = "'#' || " + " || ".join(f"lpad(lower(to_hex(floor({c} + 0.5)::INT)), 2, '0')" for c in "rgb")
ORACLE_SQL["colors"] = f"""WITH RECURSIVE s AS (SELECT p_partkey, 0 AS k, (p_partkey * 7 % 256)::DOUBLE AS r, (p_partkey * 13 % 256)::DOUBLE AS g, (p_partkey * 29 % 256)::DOUBLE AS b FROM part
UNION ALL SELECT p_partkey, k + 1, r * 0.95::DOUBLE, g * 0.95::DOUBLE, b * 0.95::DOUBLE FROM s WHERE k < 60 AND 1.05::DOUBLE / ({LUM} + 0.05::DOUBLE) < 4.5)
SELECT p_partkey, arg_min({HEX}, k) AS plain, arg_max({HEX}, k) AS readable FROM s GROUP BY p_partkey"""
