"""The queries of lines met with lines, and the SQL that checks them, on numbers made from the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import resume_text
from pagewright.operators import matching
from pagewright.plans.catalog import LINES, doc_lines, longs, read
from pagewright.plans.checker import quoted
from pagewright.plans.writing import ENTRIES, HEADINGS, LOOKED_UP, headed_lines

SHIFTS = [{"x0": 0, "x1": 300, "low": 0, "high": 200, "dy": -50}, {"x0": 0, "x1": 600, "low": -60, "high": 90, "dy": 7}]
FONTS = ["ABCDEF+Lato-Regular", "Lato-Bold", "Lato-Italic", "Lato-BoldItalic", "Arial"]


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of lines 14 points apart, the right one 3 lower, from the top of pages 842 high."""
    n = F.col("line_no").cast("long")
    right = n % 2 == 1
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), n.alias("id"), "text", F.when(right, 320.0).otherwise(40.0).alias("x"), (830 - 14 * F.floor(n / 2) - F.when(right, 3).otherwise(0)).cast("double").alias("y"), F.least(F.lit(250.0), 5.0 * F.length("text")).alias("width"), F.lit(10.0).alias("size"))


def line_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return longs(matching.same_lines(lines, lines.withColumn("y", F.col("y") + F.col("id") % 3 * 0.3).withColumn("id", F.col("id") + 1000)))


def margin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir).withColumn("text", F.when(F.col("id") % 4 == 0, F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.col("text")))
    return matching.placed_running_lines(lines.withColumn("size", 10 + (F.col("page") % 5 == 0).cast("double")), 842.0)


def shown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    runs = lines.where("id % 3 <> 0").select("page", "x", (F.col("x") + F.when(F.col("id") % 3 == 1, F.col("width")).otherwise(1.0)).alias("x1"), F.col("y") + 1, (F.col("id") % 2 == 0).alias("hidden")).toDF("page", "x0", "x1", "y", "hidden")
    return matching.shown_lines(lines, runs).select("page", "id")


def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = headed_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("line_no").cast("long").alias("id"), "text", resume_text.heading(F.col("text")).alias("section"), (F.col("line_no") % 4 == 0).alias("bold"), (10.0 + F.col("line_no") % 3).alias("size"), (12.0 + F.col("line_no") % 5).alias("gap"))
    body = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (9.5 + F.col("doc_id") % 2).alias("body"))
    return matching.heading_scores(lines, body).select("doc", "id", "score", "heading")


def resume_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array_compact(F.array(F.when(k % 2 == 0, "work"), F.when(k % 3 == 0, "skills"), F.when(k % 5 == 0, "education"), F.when(k % 7 == 0, "skills")))
    docs = read(spark, sf_dir, "part").select("p_partkey", (k % 4 + 1).alias("n_pages"), (k % 3 > 0).alias("contact"), kinds.alias("sections"), (k % 11 == 0).alias("photo"))
    return matching.likeness(docs).select("p_partkey", "score", "is_resume")


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    size = lambda a, b, c: (k * a % b + c).cast("double")
    return matching.photographs(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("image"), size(7, 500, 0).alias("x"), size(11, 700, 0).alias("y"), size(13, 320, 20).alias("w"), size(13, 310, 25).alias("h"), F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h")))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).cast("long").alias("step"), (100 - 10 * F.col("l_linenumber")).alias("size"), (40 + F.col("l_orderkey") % 60).alias("most"))
    return matching.fitting_step(rows, "size", "most")


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda c: F.get(F.array(*map(F.lit, FONTS)), (c % len(FONTS)).cast("int"))
    lines = read(spark, sf_dir, "part").select((k % 10).alias("page"), k.alias("id"), name(k).alias("font"), (k % 2 == 0).alias("bold"), (k % 3 == 0).alias("italic"))
    own = spark.range(50).select((F.col("id") % 10).alias("page"), F.col("id").alias("at"), F.concat(F.lit("F"), F.col("id").cast("string")).alias("key"), name(F.floor(F.col("id") / 10)).alias("font"), (F.col("id") % 10 > 4).alias("embedded"))
    return matching.styled_siblings(lines, own)


def moved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    y = (k * 7 % 300 - 50).cast("double")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (k % 350).cast("double").alias("x0"), (k % 350 + 40).cast("double").alias("x1"), y.alias("y0"), (y + k % 30).alias("y1"), (k % 3 > 0).alias("path"), (k % 2 == 0).alias("painted"))
    return matching.item_shifts(items, SHIFTS).select("l_orderkey", "l_linenumber", "dy")


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.wrapped(doc_lines(spark, sf_dir).withColumn("room", (60 + F.col("line_no") % 5 * 40).cast("double")), 6.0, "room")
    return longs(rows.select("doc_id", "line_no", F.array_join("wrapped", "/").alias("wrapped")))


def keys_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("/Type"), F.lit("/XObject"), F.lit("/Length"), F.col("p_partkey").cast("string"), F.lit("/Filter"), F.concat(F.lit("R"), (F.col("p_partkey") % 7).cast("string"), F.lit(".0")))
    return read(spark, sf_dir, "part").select("p_partkey", matching.dictionary_key(entries).alias("key"))


QUERIES = {
    "aligned_lines": lambda s, d: matching.nearest_baselines(lines_of(s, d).withColumn("y", F.col("y") - F.col("id") % 3)),
    "line_copies": line_copies,
    "margin_lines": margin_lines,
    "shown_lines": shown_lines,
    "line_gaps": lambda s, d: matching.gaps_above(lines_of(s, d)).select("page", "id", "gap"),
    "wrap_leading": lambda s, d: matching.wrap_leading(matching.gaps_above(lines_of(s, d)).select("page", F.col("gap").alias("step")), read(s, d, "documents").select(F.col("doc_id").alias("page"), (F.col("doc_id") % 15).cast("double").alias("lead"))),
    "photographs": photographs,
    "heading_scores": heading_scores,
    "resume_likeness": resume_likeness,
    "lost_runs": lambda s, d: matching.lost_runs(doc_lines(s, d).select(F.col("doc_id").alias("doc"), F.col("line_no").cast("long").alias("id"), "text", (F.col("line_no") % 6 == 0).alias("placed"), (F.col("line_no") % 4 == 1).alias("skipped"))),
    "fitting_steps": fitted,
    "styled_siblings": siblings,
    "learned_glyphs": lambda s, d: matching.learned_glyphs(read(s, d, "lineitem").select((F.col("l_suppkey") % 3).alias("src"), F.col("l_linenumber").cast("long").alias("font"), (F.col("l_partkey") % 50).alias("key"), F.when(F.col("l_partkey") % 50 < 25, "k").otherwise(F.col("l_returnflag")).alias("text"))),
    "moved_items": moved_items,
    "wrapped_lines": wrapped_lines,
    "dictionary_keys": keys_of,
    "repointed": lambda s, d: matching.repointed(read(s, d, "orders").select(F.col("o_orderkey").alias("owner"), F.col("o_custkey").alias("ref")), read(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").cast("long").alias("first"))),
}

PLACED = f"""{LINES}, l AS (SELECT doc_id AS page, line_no AS id, text, CASE WHEN line_no % 2 = 1 THEN 320 ELSE 40 END::DOUBLE AS x, (830 - 14 * (line_no // 2) - CASE WHEN line_no % 2 = 1 THEN 3 ELSE 0 END)::DOUBLE AS y, least(250, 5 * length(text))::DOUBLE AS width FROM lines)"""
KNOWN = ", ".join(f"({i}, {quoted(k)}, {'true' if v else 'false'})" for i, (k, v) in enumerate(HEADINGS.items()))
TRAITS = ", ".join(f"({i}, {quoted(f)}, {'false' if f == 'Arial' else 'true'}, {str('Bold' in f).lower()}, {str('Italic' in f).lower()})" for i, f in enumerate(FONTS))
ORACLE_SQL = {
    "aligned_lines": f"""WITH {PLACED}, m AS (SELECT page, id, x, y - id % 3 AS y, width FROM l), met AS (SELECT a.page, a.id, b.y - a.y AS dy, greatest(0, b.x - a.x - a.width, a.x - b.x - b.width) + 4 * abs(b.y - a.y) AS k, b.id AS oid FROM m a JOIN m b ON a.page = b.page AND a.id <> b.id AND abs(b.y - a.y) BETWEEN 0.01 AND 6)
SELECT page, id, arg_min(dy, (k, oid)) AS dy FROM met GROUP BY page, id""",
    "line_copies": f"WITH {PLACED} SELECT a.page, a.id, min(b.id) + 1000 AS other FROM l a JOIN l b ON a.page = b.page AND a.text = b.text AND a.x = b.x AND abs(b.y + b.id % 3 * 0.3::DOUBLE - a.y) < 0.5 GROUP BY a.page, a.id",
    "margin_lines": rf"""WITH {PLACED}, e AS (SELECT page, id, x, y, width, CASE WHEN page % 5 = 0 THEN 11 ELSE 10 END AS size, CASE WHEN id % 4 = 0 THEN 'Page #' ELSE trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) END AS t FROM l WHERE (id % 4 = 0 OR trim(text) <> '') AND (y < 101.04 OR y > 757.8))
SELECT DISTINCT a.page, a.id FROM e a JOIN e b ON abs(a.page - b.page) = 1 AND a.t = b.t AND abs(a.y - b.y) < 1 AND a.size = b.size AND (abs(a.x - b.x) < 2 OR abs(a.x + a.width - b.x - b.width) < 2)""",
    "shown_lines": f"""WITH {PLACED}, r AS (SELECT page, x AS x0, x + CASE WHEN id % 3 = 1 THEN width ELSE 1 END AS x1, y + 1 AS ry, id % 2 = 0 AS hidden FROM l WHERE id % 3 <> 0),
gone AS (SELECT l.page, l.id FROM l JOIN r ON r.page = l.page AND abs(ry - y) < 4.5 AND least(x1, x + width) - greatest(x0, x) > 2 GROUP BY l.page, l.id HAVING bool_and(hidden)) SELECT page, id FROM l ANTI JOIN gone USING (page, id)""",
    "line_gaps": f"WITH {PLACED} SELECT page, id, coalesce(lag(y) OVER (PARTITION BY page ORDER BY y DESC, id) - y, 99) AS gap FROM l",
    "wrap_leading": f"""WITH {PLACED}, g AS (SELECT page, coalesce(lag(y) OVER (PARTITION BY page ORDER BY y DESC, id) - y, 99) AS q FROM l), n AS (SELECT page, q FROM g GROUP BY page, q HAVING count(*) >= 2) SELECT page, min(q) AS wrap FROM n WHERE q <= page % 15 + 0.25 GROUP BY page""",
    "photographs": """WITH i AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS image, (l_orderkey + l_linenumber) AS k FROM lineitem), s AS (SELECT *, k * 7 % 500 AS x, k * 11 % 700 AS y, k * 13 % 320 + 20 AS w, k * 13 % 310 + 25 AS h FROM i)
SELECT doc, arg_max(image, (w * h, -image)) AS image FROM s WHERE w BETWEEN 40 AND 300 AND h BETWEEN 40 AND 300 AND w::DOUBLE / h BETWEEN 0.7 AND 1.4 AND (842 - (y + h) <= 336.8 OR x + w < 208.25) AND w < 357 GROUP BY doc""",
    "heading_scores": rf"""WITH {LINES}, h(i, said, known) AS (VALUES {KNOWN}), entries(e, section) AS (VALUES {ENTRIES}), t AS (SELECT doc_id AS doc, line_no AS id, CASE WHEN line_no % 9 = 4 THEN said ELSE text END AS text, CASE WHEN line_no % 9 = 4 THEN known ELSE section IS NOT NULL END AS known FROM lines LEFT JOIN entries ON e = {LOOKED_UP} JOIN h ON (doc_id + line_no) % {len(HEADINGS)} = i),
s AS (SELECT *, 2 * known::INT + (id % 4 = 0 OR regexp_matches(text, '[A-Z]{{3}}') AND NOT regexp_matches(text, '[a-z]'))::INT + (10 + id % 3 >= 10.5 + doc % 2)::INT + (len(string_split_regex(text, '\s+')) <= 4)::INT + (12 + id % 5 >= 1.44::DOUBLE * (10 + id % 3))::INT + (NOT ends_with(text, '.'))::INT AS score FROM t)
SELECT doc, id, score::BIGINT AS score, known AND score >= 3 AS heading FROM s""",
    "resume_likeness": """WITH k AS (SELECT p_partkey, p_partkey AS k, (p_partkey % 2 = 0)::INT AS w, (p_partkey % 3 = 0 OR p_partkey % 7 = 0)::INT AS s, (p_partkey % 5 = 0)::INT AS e FROM part),
c AS (SELECT p_partkey, (k % 4 < 2)::INT + 2 * (k % 3 > 0)::INT + w + s + e + (k % 11 = 0)::INT + (w + s + e >= 2 AND w + e > 0)::INT AS score FROM k) SELECT p_partkey, score::BIGINT AS score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'unsure' ELSE 'no' END AS is_resume FROM c""",
    "lost_runs": f"""WITH {LINES}, k AS (SELECT doc_id AS doc, line_no AS id, text, line_no // 6 AS run FROM lines WHERE line_no % 4 <> 1), r AS (SELECT doc, run, min(id) AS first, count(*) AS n, max(length(text)) AS longest FROM k WHERE id % 6 <> 0 GROUP BY doc, run) SELECT doc, first, n FROM r WHERE n >= 3 OR longest >= 60""",
    "fitting_steps": """WITH s AS (SELECT l_orderkey AS doc, max(l_linenumber) AS last, min(CASE WHEN 100 - 10 * l_linenumber <= 40 + l_orderkey % 60 THEN l_linenumber - 1 END) AS first FROM lineitem GROUP BY 1)
SELECT doc, CASE WHEN first > 0 THEN first END::BIGINT AS step, CASE WHEN first = 0 THEN 'already' WHEN first IS NOT NULL THEN 'yes' ELSE 'no' END AS status FROM s""",
    "styled_siblings": f"""WITH f(i, font, lato, bold, italic) AS (VALUES {TRAITS}), l AS (SELECT p_partkey % 10 AS page, p_partkey AS id, lato, p_partkey % 2 = 0 AS b, p_partkey % 3 = 0 AS t FROM part JOIN f ON p_partkey % {len(FONTS)} = i)
SELECT page, id, 'F' || (f.i * 10 + page) AS key FROM l JOIN f ON f.lato = l.lato AND f.bold = b AND f.italic = t""",
    "learned_glyphs": """SELECT l_suppkey % 3 AS src, l_linenumber::BIGINT AS font, l_partkey % 50 AS key, min(CASE WHEN l_partkey % 50 < 25 THEN 'k' ELSE l_returnflag END) AS text, count(*) AS n, count(DISTINCT CASE WHEN l_partkey % 50 < 25 THEN 'k' ELSE l_returnflag END) > 1 AS conflict FROM lineitem GROUP BY 1, 2, 3""",
    "moved_items": """WITH k AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey + l_linenumber AS k FROM lineitem), i AS (SELECT *, k % 350 AS x0, k % 350 + 40 AS x1, k * 7 % 300 - 50 AS y0, k * 7 % 300 - 50 + k % 30 AS y1, CASE WHEN k % 2 = 0 THEN least(k % 30 / 2, 6) ELSE 0.1 END AS poke, k % 3 > 0 AS path FROM k),
one AS (SELECT *, CASE WHEN x1 <= 301 AND (y0 + y1) / 2 BETWEEN 0 AND 200 AND (NOT path OR y1 <= 200 + poke) THEN -50 ELSE 0 END AS d FROM i)
SELECT l_orderkey, l_linenumber, (d + CASE WHEN x1 <= 601 AND (y0 + y1) / 2 + d BETWEEN -60 AND 90 AND (NOT path OR y1 + d <= 90 + poke) THEN 7 ELSE 0 END)::DOUBLE AS dy FROM one""",
    # a step for each word, with what stands on the line under way
    "wrapped_lines": rf"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, line_no, 60 + line_no % 5 * 40 AS room, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM lines),
s AS (SELECT doc_id, line_no, room, w, 0 AS i, '' AS wrapped, 0 AS used FROM w UNION ALL SELECT doc_id, line_no, room, w, i + 1, CASE WHEN i = 0 THEN w[1] WHEN (used + 1 + length(w[i + 1])) * 6 <= room + 0.25 THEN wrapped || ' ' || w[i + 1] ELSE wrapped || '/' || w[i + 1] END,
  CASE WHEN i > 0 AND (used + 1 + length(w[i + 1])) * 6 <= room + 0.25 THEN used + 1 + length(w[i + 1]) ELSE length(w[i + 1]) END FROM s WHERE i < len(w))
SELECT doc_id, line_no, wrapped FROM s WHERE i = len(w)""",
    "dictionary_keys": "SELECT p_partkey, '/Filter=R' || p_partkey % 7 || '.0|/Type=/XObject' AS key FROM part",
    "repointed": "SELECT o_orderkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE o_custkey END::BIGINT AS ref FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
