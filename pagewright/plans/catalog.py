"""The queries of the document operators and the SQL that checks them.

Where the tables have no geometry, items stand at places told from the words of the lines (items_of); where they have
no edit log, events are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import layout, pages, resume, text
from pagewright.session import dealt_texts

QUERY = "ea"
WORD = "the"
#: Two blocks trade places by way of one far off.
SWAP = [(0, 400, 0, 200, 5000), (0, 400, 200, 400, -200), (0, 400, 5000, 5200, -4800)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to all cores, where working on one costs more than moving it: a small file is one task otherwise."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(read(spark, sf_dir, "documents"))


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, a document's in one of many tasks."""
    return text.lines(dealt_texts(read(spark, sf_dir, "documents").select("doc_id", "text")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.items_of(dealt_lines(spark, sf_dir))


LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
ITEMS = rf"""{LINES},
gaps AS (SELECT doc_id, line_no, regexp_extract_all(text, '[^ ]+') AS m, string_split_regex(text, '[^ ]+') AS g FROM lines),
words AS (SELECT doc_id, line_no, unnest(m) AS s, generate_subscripts(m, 1) AS i, g FROM gaps WHERE len(m) > 0),
items AS (SELECT doc_id AS page, line_no, i - 1 AS seq, s, (40 + 7 * (sum(length(g[i]) + length(s)) OVER (PARTITION BY doc_id, line_no ORDER BY i) - length(s)))::DOUBLE AS x, (6 * length(s))::DOUBLE AS w, (40 + 14 * line_no)::DOUBLE AS top, 10.0::DOUBLE AS h FROM words)"""
SPACE = scalars.SPACE


def hits_sql(pattern: str, keep: str = "true") -> str:
    return rf"""{LINES},
gaps AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM lines),
each AS (SELECT doc_id, line_no, text, unnest(m) AS hit, generate_subscripts(m, 1) AS i, g FROM gaps WHERE len(m) > 0),
placed AS (SELECT *, (sum(length(g[i]) + length(hit)) OVER (PARTITION BY doc_id, line_no ORDER BY i))::BIGINT AS stop FROM each),
hits AS (SELECT doc_id, line_no, text, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS hit_no, stop - length(hit) AS start, stop, hit FROM placed WHERE {keep})"""


HIT_COLUMNS = """doc_id, line_no, hit_no, start, stop AS "end", hit, CASE WHEN start > 28 THEN '…' ELSE '' END || substr(text, greatest(0, start - 28) + 1, least(length(text), stop + 28) - greatest(0, start - 28)) || CASE WHEN stop + 28 < length(text) THEN '…' ELSE '' END AS snippet"""


def hits(spark: SparkSession, sf_dir: str, query: str, whole_word: bool) -> DataFrame:
    found = text.find_text(doc_lines(spark, sf_dir), text.find_pattern(query, whole_word))
    return longs(found.select("doc_id", "line_no", "hit_no", "start", "end", "hit", "snippet"))


def find_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    found = text.find_text(doc_lines(spark, sf_dir), text.find_pattern(QUERY)).groupBy("doc_id").agg(F.count("*").alias("n"))
    out = docs.join(found, "doc_id", "left").groupBy("source")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"), F.count("n").alias("n_docs_hit"), F.count("*").alias("n_docs"))


def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.replace_text(doc_lines(spark, sf_dir), text.find_pattern(QUERY), "$EA")
    return longs(out.where("n_hits > 0").select("doc_id", "line_no", "n_hits", "replaced"))


def delete_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.delete_hits(doc_lines(spark, sf_dir), text.find_pattern(WORD, True))
    return longs(out.where("deleted <> text").select("doc_id", "line_no", "deleted"))


def job_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """At most 12 words, the limit of the report."""
    return [r["word"] for r in resume.common_words(read(spark, sf_dir, "benchmark")).orderBy("rank").collect()]


JD = """jd AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, regexp_replace(unnest(w), '[.-]+$', '') AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z+#.-]{3,}') AS w FROM benchmark)),
counted AS (SELECT word, count(*) AS n, min((item_id, pos)) AS first FROM jd WHERE word NOT IN (%s) GROUP BY word HAVING count(*) >= 2),
ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM counted),
words AS (SELECT * FROM ranked WHERE rank <= 12)""" % ", ".join(f"'{w}'" for w in resume.STOP)
MATCHES = """matches AS (SELECT doc_id, count(word) FILTER (regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9])' || regexp_escape(word) || '($|[^a-z0-9])')) AS found, count(word) AS n FROM documents LEFT JOIN words ON true GROUP BY doc_id),
scored AS (SELECT doc_id, found, CASE WHEN n = 0 THEN 100 ELSE floor(100.0::DOUBLE * found / n + 0.5) END::BIGINT AS kw_score FROM matches)"""
RISKS = r"""risks AS (SELECT doc_id, length(regexp_replace(t, '\s', '', 'g')) < 80 AS notext,
  NOT regexp_matches(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+') OR length(regexp_replace(regexp_extract(regexp_replace(t, '[0-9]{1,2}/[0-9]{4}', '', 'g'), '(\+?[0-9][0-9 \t\n().-]{8,}[0-9])', 1), '[^0-9]', '', 'g')) < 10 AS contact,
  regexp_matches(t, '(^|[^0-9A-Za-z_])(19|20)[0-9]{2}[ ]*[-–—][ ]*((19|20)[0-9]{2}|present|current|now)($|[^0-9A-Za-z_])') AS dates,
  regexp_matches(t, '[\x{E000}-\x{F8FF}\x{FFFD}\x{2190}-\x{21FF}\x{25A0}-\x{25CE}\x{2700}-\x{27BF}]|\(cid:[0-9]+\)') AS glyphs FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
graded AS (SELECT *, greatest(0, 100 - 18 * notext::INT - 18 * contact::INT - 8 * dates::INT - 8 * glyphs::INT)::BIGINT AS parse FROM risks)"""


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.keyword_match(read(spark, sf_dir, "documents"), job_words(spark, sf_dir))


def parser_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.parser_risks(read(spark, sf_dir, "documents"))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.checked_texts(read(spark, sf_dir, "documents"), job_words(spark, sf_dir)).select("doc_id", "kw_score", "parse", "score")


def jagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 points apart, less than the tolerance of a line."""
    return items(spark, sf_dir).withColumn("top", 40 + 3.0 * F.col("line_no"))


def anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(layout.anchor_lines(jagged_items(spark, sf_dir)).groupBy("page", "line").agg(F.count("*").alias("n_items"), F.min("top").alias("top")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(layout.segments(items(spark, sf_dir)))


SEGMENTS = f"""{ITEMS},
reach AS (SELECT *, max(x + w) OVER (PARTITION BY page, line_no ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM items),
broken AS (SELECT *, sum(CASE WHEN upto IS NULL OR x - upto > greatest(6, h * 0.8) THEN 1 ELSE 0 END) OVER (PARTITION BY page, line_no ORDER BY x, seq) - 1 AS seg_no FROM reach),
segs AS (SELECT page, line_no, seg_no::BIGINT AS seg_no, min(x) AS x, max(x + w) AS x1, count(*) AS n_items FROM broken GROUP BY ALL)"""


def second_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.second_column(layout.segments(items(spark, sf_dir)), 595.0)


def sized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), (8 + (n % 9) * 0.25).cast("double").alias("size"), n.cast("long").alias("chars"))


def shifted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, y = F.length("text"), F.col("line_no") * 14
    rows = doc_lines(spark, sf_dir).select("doc_id", "line_no", F.lit(40.0).alias("x0"), (40 + 6 * n).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + 10).cast("double").alias("y1"))
    return longs(layout.shifted(rows, SWAP).select("doc_id", "line_no", "dy"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("line"), F.col("event_id").alias("version"), "value")


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))
    return pages.reachable(edges, spark.range(1, 4))


def reachable_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reachable over distinct edges."""
    edges = read(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))
    return pages.reachable(edges.distinct(), spark.range(1, 4))


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(d, "MM/yyyy")).when(k == 1, F.date_format(d, "MMM yyyy")).when(k == 2, F.date_format(d, "yyyy")).otherwise("Present")
    return read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("*", scalars.norm_date(F.col("said")).alias("norm"))


def written_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.concat(F.col("p_size").cast("string"), F.when(k == 0, " KB").when(k == 1, ",5 mb").when(k == 2, "").otherwise(" bytes"))
    return read(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("*", scalars.parse_size(F.col("said")).alias("size"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    spec = F.concat(a, F.lit("-"), b, F.lit(", "), a)
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", spec.alias("spec")).select("*", scalars.parse_ranges(F.col("spec"), F.lit(40)).alias("r"))
    flat = F.array_distinct(F.flatten("r.groups"))
    return longs(out.select("l_orderkey", "l_linenumber", "spec", F.col("r.error").alias("error"), F.when(F.col("r.error").isNull(), F.size(flat)).alias("n_pages"), F.array_max(flat).alias("last_page")))


QUERIES = {
    "lines": lambda s, d: longs(doc_lines(s, d)),
    "find_text_plain": lambda s, d: hits(s, d, QUERY, False),
    "find_text_whole_word": lambda s, d: hits(s, d, WORD, True),
    "find_summary": find_summary,
    "replace_all": replace_all,
    "delete_words": delete_words,
    "contact_fields": lambda s, d: text.contact_fields(read(s, d, "documents")),
    "running_lines": lambda s, d: longs(text.running_lines(doc_lines(s, d))),
    "dedupe": lambda s, d: text.deduped(read(s, d, "documents")),
    "normal_links": lambda s, d: text.normal_links(read(s, d, "pages")),
    "jd_keywords": lambda s, d: resume.common_words(read(s, d, "benchmark")),
    "keyword_match": keyword_match,
    "parser_risks": parser_risks,
    "score": score,
    "anchor_lines": anchor_lines,
    "segments": segments,
    "second_column": second_column,
    "body_size": lambda s, d: layout.body_size(sized_lines(s, d)),
    "upper_median": lambda s, d: layout.upper_median(read(s, d, "events"), "user_id", "value"),
    "shifted_boxes": shifted_boxes,
    "reorder_pages": lambda s, d: pages.reordered(read(s, d, "conversations").select("conv_id", "turn"), 1, 3),
    "every_n_pages": lambda s, d: pages.every_n(read(s, d, "conversations").select("conv_id", "turn"), 2),
    "current_lines": lambda s, d: pages.current_lines(edit_log(s, d)),
    "reachable": reachable,
    "reachable_all_events": reachable_all_events,
    "written_dates": written_dates,
    "written_sizes": written_sizes,
    "page_ranges": page_ranges,
}

# the gaps between whole words that are the one, from right to left: what is kept of the rest, then what is kept of the gap before
WORDS_DELETED = rf"""WITH RECURSIVE {LINES}, found AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS m, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') AS g FROM lines),
joined AS (SELECT doc_id, line_no, text, string_split(g[1] || list_aggregate(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN lower(m[i]) = '{WORD}' THEN chr(1) ELSE m[i] END || g[i + 1]), 'string_agg', ''), chr(1)) AS g FROM found WHERE list_contains(list_transform(m, lambda w: lower(w)), '{WORD}')),
fold AS (SELECT doc_id, line_no, text, g, len(g) - 1 AS i, g[-1] AS rest FROM joined UNION ALL
  SELECT doc_id, line_no, text, g, i - 1, CASE WHEN starts_with(rest, ' ') AND ((i = 1 AND g[i] = '') OR ends_with(g[i], ' ')) THEN g[i] || rest[2:]
    WHEN ends_with(g[i], ' ') AND (rest = '' OR regexp_matches(rest, '^[\s.,;:!?)]')) THEN g[i][:-2] || rest ELSE g[i] || rest END FROM fold WHERE i > 0)
SELECT doc_id, line_no, rest AS deleted FROM fold WHERE i = 0 AND rest <> text"""
REACHED = """WITH RECURSIVE edges AS (SELECT DISTINCT user_id AS a, (props->>'$.k')::BIGINT AS b FROM events),
seen AS (SELECT unnest([1, 2, 3])::BIGINT AS id UNION SELECT e.b FROM seen s JOIN edges e ON e.a = s.id) SELECT id FROM seen"""
ORACLE_SQL = {
    "lines": f"WITH {LINES} SELECT doc_id, line_no, text FROM lines",
    "find_text_plain": f"WITH {hits_sql(f'(?i){QUERY}')} SELECT {HIT_COLUMNS} FROM hits",
    # RE2 has no look-behind: whole words are told apart first
    "find_text_whole_word": "WITH " + hits_sql(r"[\p{L}\p{N}_]+", f"lower(hit) = '{WORD}'") + f" SELECT {HIT_COLUMNS} FROM hits",
    "find_summary": f"WITH {hits_sql(f'(?i){QUERY}')}, n AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) SELECT source, coalesce(sum(n), 0)::BIGINT AS n_hits, count(n) AS n_docs_hit, count(*) AS n_docs FROM documents LEFT JOIN n USING (doc_id) GROUP BY source",
    "replace_all": f"WITH {LINES} SELECT doc_id, line_no, len(regexp_extract_all(text, '(?i){QUERY}'))::BIGINT AS n_hits, regexp_replace(text, '(?i){QUERY}', '$EA', 'g') AS replaced FROM lines WHERE regexp_matches(text, '(?i){QUERY}')",
    "delete_words": WORDS_DELETED,
    "contact_fields": f"SELECT doc_id, nullif(regexp_extract(text, '{text.EMAIL}'), '') AS email, nullif(regexp_extract(text, '{text.PHONE}'), '') AS phone FROM documents",
    "running_lines": f"""WITH {LINES}, normal AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '{SPACE}+', ' ', 'g')) AS norm FROM lines)
SELECT doc_id, line_no, norm FROM normal n WHERE norm <> '' AND EXISTS (SELECT 1 FROM normal o WHERE o.norm = n.norm AND (o.doc_id = n.doc_id + 1 OR o.doc_id = n.doc_id - 1))""",
    "dedupe": "SELECT doc_id, min(doc_id) OVER same AS first_id, doc_id <> min(doc_id) OVER same AS is_copy FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))",
    "normal_links": r"""WITH n AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '#.*$', ''), '/+$', '')) AS link FROM pages)
SELECT page_id, link, CASE WHEN regexp_matches(link, '^([a-z]+\.)?linkedin\.com/in/') THEN 'linkedin' WHEN starts_with(link, 'github.com/') THEN 'github' ELSE 'other' END AS kind FROM n""",
    "jd_keywords": f"WITH {JD} SELECT word, n, rank FROM words",
    "keyword_match": f"WITH {JD}, {MATCHES} SELECT doc_id, found, kw_score FROM scored",
    "parser_risks": f"WITH {RISKS} SELECT doc_id, notext, contact, dates, glyphs, parse FROM graded",
    "score": f"WITH {JD}, {MATCHES}, {RISKS} SELECT doc_id, kw_score, parse, floor(0.6::DOUBLE * kw_score + 0.4::DOUBLE * parse + 0.5)::BIGINT AS score FROM scored JOIN graded USING (doc_id)",
    "anchor_lines": f"""WITH RECURSIVE {ITEMS}, tops AS (SELECT page, 40 + 3.0::DOUBLE * line_no AS top, count(*) AS n FROM items GROUP BY ALL),
anchors AS (SELECT page, min(top) AS top FROM tops GROUP BY page UNION ALL SELECT a.page, min(t.top) FROM anchors a JOIN tops t ON t.page = a.page AND t.top > a.top + 4.5 GROUP BY a.page),
numbered AS (SELECT page, top, row_number() OVER (PARTITION BY page ORDER BY top) - 1 AS line FROM anchors)
SELECT t.page, line, sum(n)::BIGINT AS n_items, min(t.top) AS top FROM tops t ASOF JOIN numbered a ON a.page = t.page AND a.top <= t.top GROUP BY t.page, line""",
    "segments": f"WITH {SEGMENTS} SELECT * FROM segs",
    "second_column": f"""WITH {SEGMENTS}, starts AS (SELECT page, floor(x / 6 + 0.5)::BIGINT AS b, count(*) AS n FROM segs WHERE seg_no > 0 AND x > 595 * 0.28 AND x < 595 * 0.8 GROUP BY ALL),
near AS (SELECT a.page, a.b, sum(o.n)::BIGINT AS n FROM starts a JOIN starts o ON o.page = a.page AND o.b BETWEEN a.b - 1 AND a.b + 1 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, b) AS r FROM near), n_lines AS (SELECT page, count(DISTINCT line_no) AS l FROM items GROUP BY page)
SELECT page, b AS bucket, n AS lines FROM best JOIN n_lines USING (page) WHERE r = 1 AND n >= greatest(5, l * 0.15)""",
    "body_size": f"""WITH {LINES}, q AS (SELECT doc_id AS page, floor((8 + (length(text) % 9) * 0.25) * 2 + 0.5) / 2 AS q, sum(length(text)) AS n FROM lines GROUP BY ALL)
SELECT page, q::DOUBLE AS body_size FROM q QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, q) = 1""",
    "upper_median": "SELECT user_id, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "shifted_boxes": f"""WITH {LINES}, boxes AS (SELECT doc_id, line_no, 40 + 6 * length(text) AS x1, line_no * 14 + 5 AS mid FROM lines),
one AS (SELECT *, CASE WHEN x1 <= 401 AND mid BETWEEN 0 AND 200 THEN 5000 ELSE 0 END AS d1 FROM boxes), two AS (SELECT *, d1 + CASE WHEN x1 <= 401 AND mid + d1 BETWEEN 200 AND 400 THEN -200 ELSE 0 END AS d2 FROM one)
SELECT doc_id, line_no, (d2 + CASE WHEN x1 <= 401 AND mid + d2 BETWEEN 5000 AND 5200 THEN -4800 ELSE 0 END)::DOUBLE AS dy FROM two""",
    "reorder_pages": "SELECT conv_id, turn, CASE WHEN max(turn) OVER (PARTITION BY conv_id) < 3 THEN turn WHEN turn = 1 THEN 3 WHEN turn > 1 AND turn <= 3 THEN turn - 1 ELSE turn END AS new_at FROM conversations",
    "every_n_pages": "SELECT conv_id, turn // 2 AS part, CASE WHEN min(turn) = max(turn) THEN (min(turn) + 1)::VARCHAR ELSE (min(turn) + 1) || '-' || (max(turn) + 1) END AS label, count(*) AS n_pages FROM conversations GROUP BY conv_id, turn // 2",
    "current_lines": "SELECT user_id AS doc, event_type AS line, max(event_id) AS version, arg_max(value, event_id) AS value, count(*) AS n_edits FROM events GROUP BY ALL",
    "reachable": REACHED,
    "reachable_all_events": REACHED,
    "written_dates": """WITH w AS (SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%b %Y') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'Present' END AS said FROM orders)
SELECT o_orderkey, said, CASE o_orderkey % 4 WHEN 2 THEN strftime(d, '%Y') WHEN 3 THEN '' ELSE strftime(d, '%Y-%m') END AS norm FROM w""",
    "written_sizes": """WITH w AS (SELECT p_partkey, p_size, p_partkey % 4 AS k, p_size || CASE p_partkey % 4 WHEN 0 THEN ' KB' WHEN 1 THEN ',5 mb' WHEN 2 THEN '' ELSE ' bytes' END AS said FROM part),
b AS (SELECT *, CASE k WHEN 1 THEN (p_size * 1048576 + 524288) WHEN 3 THEN p_size ELSE p_size * 1024 END::BIGINT AS size FROM w) SELECT p_partkey, said, CASE WHEN size >= 10240 THEN size END AS size FROM b""",
    "page_ranges": """WITH w AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber AS a, l_quantity::INT AS b FROM lineitem),
e AS (SELECT *, CASE WHEN a > b THEN 'reversed' WHEN b > 40 THEN 'outside' END AS error FROM w)
SELECT l_orderkey, l_linenumber, a || '-' || b || ', ' || a AS spec, error, CASE WHEN error IS NULL THEN b - a + 1 END::BIGINT AS n_pages, CASE WHEN error IS NULL THEN b - 1 END::BIGINT AS last_page FROM e""",
}
