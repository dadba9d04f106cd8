"""The queries of entries, on sections made of orders, and the SQL that walks them line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import entries
from pagewright.plans.catalog import longs, read
from pagewright.plans.checker import quoted

#: A line for each order of a customer, by o_orderkey % 11: text before and after the year of its date, whether bold, and what it is (h: header, r: range of dates, s: single, t: title word, b: mark, l: lone mark, c: lower case, e: ends a sentence, n: capital and no mark at the end, y: year).
KINDS = [
    ("Acme Works, {y} - {z}", False, "hry n"), ("Senior Engineer", True, "tn"), ("• Built things.", False, "be"), ("and more of it", False, "c"), ("Example Fintech", False, "n"), ("Diploma of Design {y}", False, "hsyn"),
    ("Wrote reports.", False, "e"), ("{y}: did so well", False, "syn"), ("•", False, "l"), ("Project Atlas", True, "n"), ("Role at Firm, Jan {y} – Present", False, "hryn"),
]


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as lines of a section."""
    k = (F.col("o_orderkey") % len(KINDS)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in KINDS]), k)
    year = F.year("o_orderdate")
    text = F.replace(F.replace(of(0), F.lit("{y}"), year.cast("string")), F.lit("{z}"), (year + 2).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"), text.alias("text"), of(1).alias("bold"), F.lit(False).alias("bullet"), F.when(F.col("o_orderkey") % 7 == 0, 40.0).otherwise(14.0).alias("gap"), F.lit(10.0).alias("size"))


def told(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return longs(entries.entry_lines(section_lines(spark, sf_dir), kind).select("doc", "at", "entry", "opens", "gives", "head"))


def entries_sql(kind: str) -> str:
    """Marks step by step, then entries step by step; what a kind of line is comes from KINDS."""
    kinds = ", ".join(f"({k}, {str(bold).lower()}, {len(t.replace('{y}', '2000').replace('{z}', '2000'))}, {quoted(what)})" for k, (t, bold, what) in enumerate(KINDS))
    has = lambda c, t="what": f"contains({t}, '{c}')"
    school = "NOT item AND NOT cont AND contains(what, 'y')" if kind == "education" else "false"
    project = "NOT item AND NOT cont AND nxt IS NOT NULL AND NOT nbold AND NOT contains(what, 'e') AND (bold OR coalesce(contains(pwhat, 'e'), false))" if kind == "projects" else "false"
    name = f"NOT ({{title}}) AND NOT item AND NOT cont AND NOT {has('r')} AND NOT {has('s')} AND h1 AND {has('n')}" if kind != "projects" else "false"
    title = f"NOT item AND NOT cont AND NOT {has('r')} AND NOT {has('s')} AND (bold OR {has('t')}) AND (h1 OR h2 AND NOT i1)"
    alone = "NOT item" if kind == "work" else "false"
    return f"""
WITH RECURSIVE kinds(k, bold, len, what) AS (VALUES {kinds}),
l AS (SELECT o_custkey AS doc, o_orderkey AS pos, bold, what, CASE WHEN o_orderkey % 7 = 0 THEN 40 ELSE 14 END AS gap, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders JOIN kinds ON k = o_orderkey % {len(KINDS)}),
marks AS (SELECT doc, 0::BIGINT AS i, NULL::BIGINT AS pos, false AS pending, false AS inside, '' AS kept, '' AS what, false AS bold, false AS item, false AS cont FROM (SELECT DISTINCT doc FROM l) UNION ALL
  SELECT doc, i, pos, lone, CASE WHEN lone THEN inside ELSE item OR cont END, CASE WHEN lone THEN kept ELSE what END, what, bold, NOT lone AND item, NOT lone AND cont FROM (
    SELECT l.doc, l.i, l.pos, {has('l', 'l.what')} AS lone, m.inside, m.kept, l.what, l.bold, m.pending OR {has('b', 'l.what')} AS item,
      m.inside AND NOT (m.pending OR {has('b', 'l.what')}) AND NOT l.bold AND NOT {has('r', 'l.what')} AND l.gap < 20 AND ({has('c', 'l.what')} OR NOT {has('e', 'm.kept')}) AS cont
    FROM marks m JOIN l ON l.doc = m.doc AND l.i = m.i + 1)),
h AS (SELECT doc, pos, what, bold, item, cont, {has('h')} AND NOT item AND NOT cont AS header FROM marks WHERE i > 0 AND NOT {has('l')}),
w AS (SELECT *, coalesce(lead(header) OVER o, false) AS h1, coalesce(lead(header, 2) OVER o, false) AS h2, coalesce(lead(item) OVER o, false) AS i1, lead(pos) OVER o AS nxt, coalesce(lead(bold) OVER o, false) AS nbold, lag(what) OVER o AS pwhat, row_number() OVER o AS i FROM h WINDOW o AS (PARTITION BY doc ORDER BY pos)),
f AS (SELECT *, {title} AS title, {project} AS project, {name.format(title=title)} AS name, {school} AS school, {alone} AS alone, {has('y')} AS year, {has('r')} OR {has('s')} AS dated FROM w),
steps AS (SELECT doc, 0::BIGINT AS i, NULL::BIGINT AS pos, -1::BIGINT AS entry, 0 AS n, false AS d, false AS opener, false AS y, false AS fy, false AS al, false AS gives, false AS opens FROM (SELECT DISTINCT doc FROM l) UNION ALL
  SELECT doc, i, pos, entry + starts::INT, CASE WHEN starts THEN 1 ELSE n + 1 END, CASE WHEN starts THEN gives ELSE d OR gives END, CASE WHEN starts THEN title OR nm ELSE opener END, CASE WHEN starts THEN year ELSE y OR year END, CASE WHEN starts THEN year ELSE fy END, CASE WHEN starts THEN alone ELSE al END, gives, starts FROM (
    SELECT *, CASE WHEN starts THEN header OR sch AND dated ELSE header AND NOT d END AS gives FROM (
      SELECT *, n = 0 OR title OR project OR nm OR sch AND y OR header AND NOT ((opener OR n = 1 AND al) AND NOT d AND n <= 2) AS starts FROM (
        SELECT s.entry, s.n, s.d, s.opener, s.y, s.fy, s.al, f.*, f.name AND (s.n = 0 OR s.d) AS nm, f.school AND NOT (s.n = 1 AND NOT s.fy) AS sch FROM steps s JOIN f ON f.doc = s.doc AND f.i = s.i + 1)))),
e AS (SELECT s.doc, s.pos, s.entry, s.opens, s.gives, f.what, f.bold, f.dated, NOT (f.item OR f.cont) AS plain, row_number() OVER (PARTITION BY s.doc, s.entry ORDER BY s.pos) AS r FROM steps s JOIN f ON f.doc = s.doc AND f.i = s.i)
SELECT doc, pos AS "at", entry, opens, gives, r = 1 AND plain OR r = 2 AND plain AND coalesce(lag(plain) OVER (PARTITION BY doc, entry ORDER BY pos), false) AND (bold OR dated OR NOT {has('e')}) AS head FROM e
"""


QUERIES = {
    **{f"entries_{k}": (lambda s, d, k=k: told(s, d, k)) for k in ("work", "education", "projects")},
}
ORACLE_SQL = {f"entries_{k}": entries_sql(k) for k in ("work", "education", "projects")}
