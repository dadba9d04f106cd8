"""The queries of painted runs, bullets, alignment and content streams, and the SQL that checks them, on numbers made from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import painted, reading
from pagewright.plans.catalog import ITEMS, LINES, dealt, doc_lines, longs, read
from pagewright.plans.checker import quoted
from pagewright.plans.reading import marks

WIDTH = 595.0
STREAM = r"q 1 0 0 1 5.5 -.5 cm % note (" + "\n" + r"BT /F1 12 Tf (a \(b\) (c) \101) Tj [(x) -20 <4142>] TJ ET << /A (>>) /B << /C 1 >> >> /P BDC true EMC BI /W 2 ID xEI EIy EI Q f* 3 4 l"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("line_no").cast("long"), F.length("text")
    x = F.when(n % 5 == 0, 300.0).when(n % 5 == 1, 595.0 / 2 - k * 2.0).when(n % 5 == 2, 540.0 - k * 4.0).otherwise(40.0)
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), n.alias("id"), "text", x.alias("x"), (800 - 7.0 * n).alias("y"), (4.0 * k).alias("width"), F.lit(10.0).alias("size"))


def runs_of(lines: DataFrame) -> DataFrame:
    """Two runs for each line: at its start and, higher by its number, in its middle."""
    one = lines.select("page", (F.col("id") * 2).alias("run"), (F.col("id") * 2).alias("seq"), "x", "y", F.when(F.col("id") % 3 == 0, 3).otherwise(0).alias("mode"))
    two = lines.select("page", (F.col("id") * 2 + 1).alias("run"), (F.col("id") * 2 + 1).alias("seq"), (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("id") % 4).alias("y"), F.when(F.col("id") % 6 == 0, 7).otherwise(0).alias("mode"))
    return one.union(two)


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return longs(painted.drawn_by(lines, runs_of(lines)))


def hidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    images = lines.where("id = 12").select("page", F.lit(21).cast("long").alias("seq"), F.lit(0.0).alias("x0"), (F.col("y") - 40).alias("y0"), F.lit(595.0).alias("x1"), (F.col("y") + 60).alias("y1"))
    return painted.hidden_lines(lines, runs_of(lines), images)


def page_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    pages = read(spark, sf_dir, "documents").select(k.alias("page"), (k % 3).alias("images"), (k % 60).alias("paths"))
    lines = doc_lines(spark, sf_dir).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("page"), F.col("line_no").alias("id"), ((F.col("line_no") % 10 != 0) | (F.col("doc_id") % 2 == 1) & (F.col("line_no") > 0)).alias("hidden"))
    return painted.page_refusals(pages, lines)


def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-character and other parts of texts as runs in fonts taken in turn."""
    t = F.get(F.array(*map(F.lit, ["•", " – ", "a", "ab", "", "*", "\ue0b7", "1"])), (F.col("p_partkey") % 8).cast("int"))
    font = F.get(F.array(F.lit("Arial"), F.lit("ZapfDingbats"), F.lit(None)), (F.col("p_partkey") % 3).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", painted.is_bullet_run(t, font).alias("bullet"))


def stray_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = marks(spark, sf_dir).withColumn("y", F.col("y") + (F.col("id") % 3).cast("double"))
    return painted.stray_bullets(reading.bullet_pairs(lines))


def fonts_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    ours = read(spark, sf_dir, "lineitem").select(k.alias("page"), F.col("l_linenumber").alias("at"), F.concat(F.lit("F"), (F.col("l_linenumber") % 2).cast("string")).alias("key"))
    theirs = read(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0 or l_linenumber > 1").select(k.alias("page"), F.col("l_linenumber").alias("at"), F.concat(F.lit("g"), F.when(k % 7 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") % 2).cast("string")).alias("font"))
    return painted.fonts_by_place(ours, theirs)


def stream_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = dealt(read(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("page"), F.lit(STREAM).alias("stream"))
    return longs(painted.stream_operations(streams).withColumn("args", F.array_join("args", "|")))


def image_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as forms within forms that use parts as images; orders as pages."""
    pages = read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("page"), (500 + F.col("c_custkey") % 400).alias("long"))
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    first = read(spark, sf_dir, "customer").select(named("p", F.col("c_custkey")).alias("owner"), F.lit("form").alias("kind"), named("f", F.col("c_custkey") % 9 + 1).alias("ref"))
    nested = spark.range(1, 9).select(named("f", F.col("id")).alias("owner"), F.lit("form").alias("kind"), named("f", F.col("id") + 1).alias("ref"))
    images = spark.range(1, 10).select(named("f", F.col("id")).alias("owner"), F.lit("image").alias("kind"), named("i", F.col("id") % 7).alias("ref"))
    return longs(painted.image_uses(pages, first.union(nested).union(images), spark.createDataFrame([("i3",)], "ref string")))


QUERIES = {
    "line_runs": line_runs, "hidden_lines": hidden_lines, "page_refusals": page_refusals, "bullet_runs": bullets, "stray_bullets": stray_bullets, "fonts_by_place": fonts_by_place,
    "alignments": lambda s, d: painted.alignments(lines_of(s, d), WIDTH), "stream_operators": stream_operators, "image_uses": image_uses,
}

PLACED = f"""{LINES}, l AS (SELECT doc_id AS page, line_no AS id, text, CASE line_no % 5 WHEN 0 THEN 300 WHEN 1 THEN 297.5 - length(text) * 2 WHEN 2 THEN 540 - length(text) * 4 ELSE 40 END::DOUBLE AS x, 800 - 7.0::DOUBLE * line_no AS y, 4.0::DOUBLE * length(text) AS width FROM lines)"""
RUNS = f"""{PLACED}, runs AS (SELECT page, id * 2 AS run, x, y, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END AS mode FROM l UNION ALL SELECT page, id * 2 + 1, x + width / 2, y + id % 4, CASE WHEN id % 6 = 0 THEN 7 ELSE 0 END FROM l),
met AS (SELECT l.page, l.id, run, run AS seq, mode::BIGINT AS mode FROM l JOIN runs r ON r.page = l.page AND abs(r.y - l.y) <= 3 AND r.x >= l.x - 3 AND r.x <= l.x + width - 0.5)"""
#: What STREAM holds, told by hand.
OPERATORS = [
    ("q", ""), ("cm", "1|0|0|1|5.5|-.5"), ("BT", ""), ("Tf", "/F1|12"), ("Tj", r"(a \(b\) (c) \101)"), ("TJ", "[(x) -20 <4142>]"), ("ET", ""), ("BDC", "<< /A (>>) /B << /C 1 >> >>|/P"), ("EMC", "true"), ("BI", ""), ("ID", "/W|2"), ("EI", ""), ("Q", ""), ("f*", ""), ("l", "3|4"),
]


def spans() -> list[tuple[int, int]]:
    """Where the operators stand, found by their own texts one after another."""
    out, at = [], 0
    for op, args in OPERATORS:
        first = (args.split("|")[0] if args else op)
        start = STREAM.index(first, STREAM.index("EIy EI") + 4 if op == "EI" else at)
        end = STREAM.index(op, start + (sum(map(len, args.split("|"))) if args else 0)) + len(op)
        out.append((start, end))
        at = end
    return out


VALUES = ", ".join(f"({i}, {quoted(op)}, {quoted(args)}, {a}, {b})" for i, ((op, args), (a, b)) in enumerate(zip(OPERATORS, spans(), strict=True)))
ORACLE_SQL = {
    "line_runs": f"WITH {RUNS} SELECT * FROM met",
    "hidden_lines": f"""WITH {RUNS}, told AS (SELECT page, id, bool_and(mode IN (3, 7)) AS invisible, max(seq) AS last FROM met GROUP BY ALL), i AS (SELECT page, y - 40 AS y0, y + 60 AS y1 FROM l WHERE id = 12)
SELECT page, id, CASE WHEN invisible THEN 'invisible' ELSE 'covered' END AS reason FROM told JOIN l USING (page, id) LEFT JOIN i USING (page) WHERE invisible OR last < 21 AND 0 <= x + 1 AND 595 >= x + width - 1 AND y0 <= y - 2.2::DOUBLE + 1 AND y1 >= y + 7.8::DOUBLE - 1""",
    "page_refusals": f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (line_no % 10 <> 0 OR doc_id % 2 = 1 AND line_no > 0) AS h FROM lines WHERE doc_id % 4 <> 0 GROUP BY doc_id),
c AS (SELECT doc_id AS page, CASE WHEN n IS NOT NULL THEN CASE WHEN h >= 0.8::DOUBLE * n THEN 'ocr' END WHEN doc_id % 3 > 0 AND doc_id % 60 < 40 THEN 'scanned' WHEN doc_id % 60 >= 40 THEN 'outlines' ELSE 'empty' END AS code FROM documents LEFT JOIN n USING (doc_id)) SELECT * FROM c WHERE code IS NOT NULL""",
    "bullet_runs": "SELECT p_partkey, p_partkey % 8 IN (0, 1, 5, 6) OR p_partkey % 8 IN (2, 7) AND p_partkey % 3 = 1 AS bullet FROM part",
    "stray_bullets": f"""WITH {ITEMS}, l AS (SELECT page, line_no * 10000 + seq AS id, x, 842 - 14 * line_no + (line_no * 10000 + seq) % 3 AS y, regexp_matches(lower(s), '^[^a-z]$') AS bullet FROM items),
met AS (SELECT t.page, t.id, b.id AS b, t.y - b.y AS dy FROM l t JOIN l b ON t.page = b.page AND b.bullet AND NOT t.bullet AND t.x - b.x > 2.5 AND t.x - b.x < 30 AND abs(t.y - b.y) <= 18),
near AS (SELECT * FROM met m WHERE abs(dy) <= 1.2 OR NOT EXISTS (SELECT 1 FROM met o WHERE o.page = m.page AND o.id = m.id AND o.b <> m.b AND abs(o.dy) <= 5)),
best AS (SELECT page, b AS id, arg_min(id, (abs(dy) * CASE WHEN dy > 0 THEN 1.5 ELSE 1 END, id)) AS target, arg_min(dy, (abs(dy) * CASE WHEN dy > 0 THEN 1.5 ELSE 1 END, id)) AS dy FROM near GROUP BY page, b)
SELECT page, id, target, dy::DOUBLE AS dy FROM best WHERE abs(dy) > 1.2""",
    "fonts_by_place": """WITH o AS (SELECT l_orderkey AS page, count(*) AS n, count(*) FILTER (l_orderkey % 5 <> 0 OR l_linenumber > 1) AS m FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey AS page, 'F' || l_linenumber % 2 AS key, 'g' || CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber ELSE l_linenumber % 2 END AS font FROM lineitem), bad AS (SELECT page FROM f GROUP BY page, key HAVING count(DISTINCT font) > 1)
SELECT DISTINCT page, key, font FROM f JOIN o USING (page) WHERE n = m AND page NOT IN (SELECT page FROM bad)""",
    "alignments": rf"""WITH {PLACED}, a AS (SELECT *, x + width AS r, max(x + width) OVER (PARTITION BY page) AS far FROM l WHERE trim(text) <> ''),
d AS (SELECT a.*, (SELECT bool_or(abs(o.x - a.x) < 1 AND abs(o.y - a.y) < 40) FROM a o WHERE o.page = a.page AND o.id <> a.id AND abs(o.y - a.y) >= 3 AND abs(o.r - a.r) < 1.5) AS near,
  (SELECT bool_or(abs(o.x - a.x) > 1) FROM a o WHERE o.page = a.page AND o.id <> a.id AND abs(o.y - a.y) >= 3 AND abs(o.r - a.r) < 1.5) AS ragged FROM a)
SELECT page, id, CASE WHEN near AND length(trim(text)) - length(replace(trim(text), ' ', '')) >= 3 AND width > 297.5 THEN 'justify' WHEN r > 327.25 AND x > 238 AND (coalesce(ragged, false) OR near IS NULL AND r >= far - 1.5) THEN 'right'
  WHEN abs(x + width / 2 - 297.5) < 2 AND x > 89.25 THEN 'center' ELSE 'left' END AS align FROM d""",
    "stream_operators": f"""SELECT p_partkey AS page, f.* FROM part, (VALUES {VALUES}) AS f(i, op, args, start, "end")""",
    # customers use form c % 9 + 1, which uses the four after it, five deep in all
    "image_uses": """WITH u AS (SELECT c_custkey % 9 + 1 + unnest(range(0, 4)) AS f, 500 + c_custkey % 400 AS long FROM customer) SELECT 'i' || f % 7 AS image, max(long)::BIGINT AS longest FROM u WHERE f <= 9 AND f % 7 <> 3 GROUP BY 1""",
}
