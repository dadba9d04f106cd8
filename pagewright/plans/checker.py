"""The queries of the parser check and the SQL that checks them: every rule, the keywords, the examples and the score.

Documents' lines are put on pages of 40 lines; cells between bars are items. Every third line is one of SAID, which the
texts lack: headings, contacts, dates and symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import checker, resume
from pagewright.plans.catalog import LINES, dealt_lines, longs, read

SAID = [
    "EXPERIENCE", "Education", "CAREER OBJECTIVE", "Technical Skills", "Jan '21 - Feb '22", "2019 - 2021", "01/2020 - 03/2021", "Jan 2020 - Mar 2021", "12/05/2020 and more", "● Item → next", "Mumbai, India", "me@mail.example.com",
    "+91 98765 43210", "PROJECTS", "Summary", "Certifications & more", "PERSONAL DETAILS", "2nd March", "2020-11", "a | b | c", "d | e | f", "g | h | i", "LLMs and Python on RESTful services", "",
]
JOB = "Python and LLMs, RESTful APIs, PostgreSQL and Node.js; AWS, C++ and C# with LangGraph. AWSs and SAPs. pipelines pipelines testing, testing pipelines kafka kafka"
PER_PAGE = 40


def said_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ((F.col("doc_id") * 7 + F.col("line_no")) % len(SAID)).cast("int")
    said = F.when(F.col("line_no") % 3 == 1, F.get(F.array(*map(F.lit, SAID)), k)).otherwise(F.col("text"))
    return dealt_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.floor(F.col("line_no") / PER_PAGE).alias("page"), F.col("line_no").cast("long").alias("line"), said.alias("text"))


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The checked lines and the pages."""
    lines = said_lines(spark, sf_dir)
    pages = lines.select("doc", "page").distinct().select("doc", "page", F.lit(595.0).alias("w"), F.lit(842.0).alias("h"), ((F.col("doc") + F.col("page")) % 11 == 0).cast("long").alias("big"), ((F.col("doc") * 3 + F.col("page")) % 5 == 0).cast("long").alias("small"))
    cells = lines.select("doc", "page", "line", F.posexplode(F.split("text", r" \| ", -1)).alias("seq", "s"))
    items = cells.select(
        "doc", "page", "line", "seq", "s", (40 + 150 * F.col("seq")).cast("double").alias("x"), (6 * F.length("s")).cast("double").alias("w"), (30 + 20 * (F.col("line") % PER_PAGE)).cast("double").alias("top"), F.lit(10.0).alias("h"),
        F.when((F.col("doc") + F.col("line")) % 50 == 0, "FontAwesome").otherwise("Body").alias("font"),
    )
    return checker.checked_lines(checker.parser_lines(items), pages), pages


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.risks(*tables(spark, sf_dir))


def job(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, JOB)], "item_id long, text string")


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords, at most 30 of the report, come to the driver."""
    words = [r["keyword"] for r in checker.job_keywords(job(spark)).orderBy("rank").collect()]
    return checker.analyzed(risks(spark, sf_dir), words)


def benchmark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.job_keywords(read(spark, sf_dir, "benchmark"))


def one_rule(rule: str):
    return lambda s, d: risks(s, d).where(F.col(rule).isNotNull()).select("doc", F.col(rule).alias("level"))


QUERIES = {
    "analyze": analyze,
    **{f"risk_{r}": one_rule(r) for r in checker.RISKS},
    "risk_examples": lambda s, d: checker.risk_examples(tables(s, d)[0]),
    "job_keywords": benchmark_keywords,
    "checker_lines": lambda s, d: longs(tables(s, d)[0].select("doc", "page", "line", "text", F.size("segs").alias("n_segs"), "email", "place", "edge", "icon", "date", "symbol", "grid", F.col("table").alias("in_table"), F.size("heads").alias("n_heads"))),
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# the second and third forms say what a back-reference and a look-behind say
BAD = "(?i)" + "|".join([checker.BAD_DATES[0], *(rf"\b[0-9]{{1,2}}{c}[0-9]{{1,2}}{c}[0-9]{{2,4}}\b" for c in ("/", "[.]", "-")), r"(^|[^/0-9A-Za-z_])(19|20)[0-9]{2}\s*[-–—]\s*((19|20)[0-9]{2}|present|current|now)\b", *checker.BAD_DATES[3:]])
GUESS = " ".join(f"WHEN regexp_matches(n, {quoted(p)}) THEN {quoted(k)}" for k, p in checker.GUESSES)
STANDARD = " ".join(f"WHEN regexp_matches(n, {quoted(p)}) THEN {quoted(k)}" for k, p in checker.STANDARD.items())
CHECKED = f"""{LINES},
said AS (SELECT doc_id AS doc, line_no // {PER_PAGE} AS page, line_no AS line, CASE WHEN line_no % 3 = 1 THEN [{', '.join(map(quoted, SAID))}][((doc_id * 7 + line_no) % {len(SAID)} + 1)::INT] ELSE text END AS text FROM lines),
places AS (SELECT doc, page, max(((doc + page) % 11 = 0)::BIGINT) AS big, max(((doc * 3 + page) % 5 = 0)::BIGINT) AS small FROM said GROUP BY ALL),
parts AS (SELECT doc, page, line, unnest(c) AS s, generate_subscripts(c, 1) - 1 AS seq FROM (SELECT *, string_split(text, ' | ') AS c FROM said)),
cells AS (SELECT *, 40.0::DOUBLE + 150 * seq AS x, 6 * length(s) AS w, trim(s, {WHITE}) AS t FROM parts WHERE trim(s, {WHITE}) <> ''),
gaps AS (SELECT *, x - max(x + w) OVER (PARTITION BY doc, line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM cells),
broken AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, line ORDER BY seq) AS seg, CASE WHEN gap > 1.5 AND gap <= 8 THEN ' ' ELSE '' END || t AS p FROM gaps),
segs AS (SELECT doc, page, line, seg, min(x) AS x, string_agg(p, '' ORDER BY seq) AS s, sum(length(t)) AS chars FROM broken GROUP BY ALL),
told AS (SELECT doc, page, line, list(x ORDER BY seg) AS xs, list(s ORDER BY seg) AS ss, regexp_replace(string_agg(s, '   ' ORDER BY seg), '\\s{{4,}}', '   ', 'g') AS text, sum(chars) AS chars, 30 + 20 * (line % {PER_PAGE}) AS top FROM segs GROUP BY doc, page, line),
near AS (SELECT *, lag(xs) OVER (PARTITION BY doc, page ORDER BY line) AS before, row_number() OVER (PARTITION BY doc ORDER BY line) AS nth FROM told),
flags AS (SELECT *, regexp_matches(text, {quoted(checker.EMAIL)}) AS email, nth <= 25 AND regexp_matches(text, {quoted(rf'(?i)\b({checker.PLACE})\b|,\s*[A-Z]{{2}}\b')}) AS place,
  (top < 42.1 OR top > 799.9) AND regexp_matches(text, '@|[0-9]{{5,}}|[0-9]{{3}}[\\s-][0-9]{{3}}') AS edge, regexp_matches(text, {quoted(checker.PRIVATE)}) OR (doc + line) % 50 = 0 AS icon,
  regexp_matches(text, {quoted(BAD)}) AND NOT (regexp_matches(text, {quoted('(?i)' + checker.GOOD_DATE)}) AND NOT regexp_matches(text, {quoted(checker.FULL_DATE)})) AS date, regexp_matches(text, {quoted(checker.SYMBOLS)}) AS symbol,
  coalesce(len(xs) >= 2 AND len(before) >= 2 AND len([x FOR x IN xs IF len([q FOR q IN before IF abs(q - x) < 5]) > 0]) >= 2, false) AS grid FROM near),
marked AS (SELECT *, grid AND coalesce(lag(grid) OVER (PARTITION BY doc, page ORDER BY line), false) AS in_table FROM flags),
shown AS (SELECT doc, page, line, len(ss) AS n_segs, trim(unnest(ss), {WHITE}) AS t, generate_subscripts(ss, 1) AS nth_seg FROM told),
named AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '\\s+', ' ', 'g'), '[&/].*$', '')) AS n, t = upper(t) AND NOT contains(t, 'ß') AS caps FROM shown),
kept AS (SELECT *, CASE {STANDARD} END AS standard, CASE {GUESS} END AS guess FROM named WHERE length(t) <= 40 AND NOT regexp_matches(t, '[0-9@:|•]') AND len(string_split_regex(t, '\\s+')) <= 5 AND (caps AND regexp_matches(t, '[A-Z]{{3}}') OR n_segs = 1) AND regexp_matches(lower(t), {quoted(checker.HEADING_WORD)})),
heads AS (SELECT doc, page, line, nth_seg, t, coalesce(standard, guess) AS key, standard IS NULL AS odd FROM kept WHERE standard IS NOT NULL OR caps AND NOT regexp_matches(n, {quoted(checker.ALSO_STANDARD)}))"""
RULED = f"""{CHECKED},
starts AS (SELECT doc, page, floor(unnest(xs[2:]) / 6 + 0.5::DOUBLE) AS b, unnest(xs[2:]) AS x FROM told), counted AS (SELECT doc, page, b, count(*) AS n FROM starts WHERE x > 166.6 AND x < 476 GROUP BY ALL),
best AS (SELECT a.doc, a.page, a.b, sum(o.n) AS n FROM counted a JOIN counted o ON o.doc = a.doc AND o.page = a.page AND abs(o.b - a.b) <= 1 GROUP BY ALL),
sizes AS (SELECT p.doc, p.page, big, small, coalesce((SELECT sum(chars) FROM told t WHERE t.doc = p.doc AND t.page = p.page), 0) < 40 AS empty,
  coalesce((SELECT max(n) FROM best b WHERE b.doc = p.doc AND b.page = p.page), 0) >= greatest(5, 0.15::DOUBLE * (SELECT count(*) FROM told t WHERE t.doc = p.doc AND t.page = p.page)) AS col FROM places p),
by_page AS (SELECT doc, count(*) AS n, bool_or(col) AS col, bool_or(empty) AS empty, sum(big) AS big, sum(small) AS small FROM sizes GROUP BY doc),
by_line AS (SELECT doc, string_agg(text, chr(10) ORDER BY line) AS text, bool_or(email) AS email, bool_or(place) AS place, bool_or(edge) AS edge, bool_or(icon) AS icon, bool_or(date) AS date, bool_or(symbol) AS symbol, bool_or(in_table) AS tab FROM marked GROUP BY doc),
by_head AS (SELECT doc, bool_or(odd) AS odd, list(DISTINCT key) FILTER (key IS NOT NULL) AS seen FROM heads GROUP BY doc),
d AS (SELECT doc, coalesce(text, '') AS text, n, col, empty, big, small, email, place, edge, icon, date, symbol, tab, odd, coalesce(seen, []) AS seen, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS chars,
  length(regexp_replace(regexp_extract(regexp_replace(coalesce(text, ''), '[0-9]{{1,2}}/[0-9]{{4}}', '', 'g'), {quoted(checker.PHONE)}), '[^0-9]', '', 'g')) AS digits FROM by_page LEFT JOIN by_line USING (doc) LEFT JOIN by_head USING (doc)),
risks AS (SELECT doc, text, CASE WHEN chars < 80 OR empty THEN 'high' END AS notext, CASE WHEN big > 0 AND chars >= 80 THEN 'med' END AS images, CASE WHEN col THEN 'high' END AS columns, CASE WHEN tab THEN 'med' END AS tables,
  CASE WHEN icon OR small >= 2 THEN 'med' END AS icons, CASE WHEN NOT coalesce(email, false) OR digits < 10 THEN 'high' WHEN NOT coalesce(place, false) THEN 'low' END AS contact, CASE WHEN edge THEN 'med' END AS header, CASE WHEN odd THEN 'med' END AS headings,
  CASE WHEN NOT (list_contains(seen, 'experience') AND list_contains(seen, 'education')) THEN 'med' WHEN len(seen) < 5 THEN 'low' END AS sections, CASE WHEN date THEN 'med' END AS dates, CASE WHEN n > 2 THEN 'low' END AS pages, CASE WHEN symbol THEN 'med' END AS glyphs FROM d)"""


def sql_keyword(k: str) -> str:
    return "(?i)" + checker.ALIASES[k.lower()] if k.lower() in checker.ALIASES else checker.keyword_pattern(k)


JOB_WORDS = f"""jobs AS (SELECT @id AS item_id, @text AS text FROM @table),
fixed AS (SELECT 0 AS kind, k.i::BIGINT AS a, 0::BIGINT AS b, k.w AS k FROM (VALUES {', '.join(f'({i}, {quoted(k)}, {quoted(sql_keyword(k))})' for i, k in enumerate(checker.KEYWORDS))}) AS k(i, w, p) WHERE EXISTS (SELECT 1 FROM jobs WHERE regexp_matches(text, p))),
tokens AS (SELECT 1 AS kind, item_id::BIGINT AS a, generate_subscripts(t, 1) - 1 AS b, unnest(t) AS t FROM (SELECT item_id, regexp_extract_all(text, {quoted(checker.TOKENS)}) AS t FROM jobs)),
plain AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, regexp_replace(unnest(w), '[.-]+$', '') AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z+#.-]{{3,}}') AS w FROM jobs)),
common AS (SELECT word, row_number() OVER (ORDER BY n DESC, first) AS rank FROM (SELECT word, count(*) AS n, min((item_id, pos)) AS first FROM plain WHERE word NOT IN ({', '.join(map(quoted, resume.STOP))}) GROUP BY word HAVING count(*) >= 2)),
every AS (SELECT * FROM fixed UNION ALL SELECT kind, a, b, CASE WHEN regexp_matches(t, '[A-Z]{{2,}}s$') THEN t[:-2] ELSE t END FROM tokens WHERE NOT regexp_matches(t, {quoted(checker.NOT_TOKENS)}) UNION ALL SELECT 2, rank, 0, word FROM common WHERE rank <= 12),
firsts AS (SELECT min((kind, a, b)) AS o, arg_min(k, (kind, a, b)) AS keyword FROM every GROUP BY lower(k)), keywords AS (SELECT keyword, row_number() OVER (ORDER BY o) AS rank FROM firsts QUALIFY rank <= 30)"""


def job_words(item: str, text: str, table: str) -> str:
    return JOB_WORDS.replace("@id", item).replace("@text", text).replace("@table", table)


BY_SQL = ", ".join(f"({quoted(k.lower())}, {quoted('(?i)' + p)})" for k, p in checker.ALIASES.items())
ORACLE_SQL = {
    **{f"risk_{r}": f"WITH {RULED} SELECT doc, {r} AS level FROM risks WHERE {r} IS NOT NULL" for r in checker.RISKS},
    "checker_lines": f"WITH {CHECKED}, h AS (SELECT doc, page, line, count(*) AS n FROM heads GROUP BY ALL) SELECT m.doc, m.page, m.line, text, len(ss) AS n_segs, email, place, edge, icon, date, symbol, grid, in_table, coalesce(h.n, 0) AS n_heads FROM marked m LEFT JOIN h USING (doc, page, line)",
    "job_keywords": "WITH " + job_words("item_id", "coalesce(text, '')", "benchmark") + " SELECT keyword, rank FROM keywords",
    "analyze": f"""WITH {RULED}, {job_words("1", quoted(JOB), "(SELECT 1)")}, aliases(k, p) AS (VALUES {BY_SQL}),
patterns AS (SELECT coalesce(p, '(?i)(^|[^a-z0-9])' || regexp_escape(keyword) || '($|[^a-z0-9])') AS p FROM keywords LEFT JOIN aliases ON k = lower(keyword)),
hits AS (SELECT doc, count(*) FILTER (regexp_matches(text, p)) AS found, floor(100.0::DOUBLE * count(*) FILTER (regexp_matches(text, p)) / count(*) + 0.5::DOUBLE)::BIGINT AS kw_score FROM risks, patterns GROUP BY doc),
levels AS (SELECT *, [{', '.join(checker.RISKS)}] AS l FROM risks),
graded AS (SELECT *, len([x FOR x IN l IF x IS NOT NULL]) AS n_risks, greatest(0, 100 - coalesce(list_sum([CASE x WHEN 'high' THEN 18 WHEN 'med' THEN 8 ELSE 3 END FOR x IN l IF x IS NOT NULL]), 0))::BIGINT AS parse FROM levels)
SELECT doc, {', '.join(checker.RISKS)}, n_risks, parse, found, kw_score, floor(0.6::DOUBLE * kw_score + 0.4::DOUBLE * parse + 0.5::DOUBLE)::BIGINT AS score FROM graded JOIN hits USING (doc)""",
    "risk_examples": f"""WITH {CHECKED}, shown_lines AS (SELECT doc, page, line, 0 AS nth_seg, 'tables' AS risk, text FROM marked WHERE grid UNION ALL SELECT doc, page, line, 0, 'icons', text FROM marked WHERE icon UNION ALL SELECT doc, page, line, 0, 'header', text FROM marked WHERE edge
  UNION ALL SELECT doc, page, line, 0, 'dates', text FROM marked WHERE date UNION ALL SELECT doc, page, line, 0, 'glyphs', array_to_string([CASE WHEN regexp_matches(c, '^[ -~•–—’]?$') THEN c ELSE '⟨U+' || to_hex(unicode(c)) || '⟩' END FOR c IN string_split(text, '')], '') FROM marked WHERE symbol
  UNION ALL SELECT doc, page, line, nth_seg, 'headings', t || coalesce(' → use “' || upper(key[1]) || key[2:] || '”', '') FROM heads WHERE odd),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, risk ORDER BY page, line, nth_seg) AS n FROM shown_lines) SELECT doc, risk, string_agg(text, ' | ' ORDER BY n) AS examples FROM ranked WHERE n <= 4 GROUP BY doc, risk""",
}
