"""The queries of search and replacement in full: documents are files, forty lines a page; keys say which lines can't be edited, have changed or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import searching, text
from pagewright.plans.catalog import LINES, doc_lines, longs, read

QUERY, REPLACEMENT, PAGE = "and", "&", 40


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("line_no") % 7 == 3, "locked").when(F.col("line_no") % 19 == 2, "turned")
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("file"), F.floor(F.col("line_no") / PAGE).alias("page"), F.col("line_no").cast("long").alias("line"), "text", reason.alias("reason"), (F.col("line_no") % 11 == 5).alias("verify"), (F.col("line_no") % 2 == 0).alias("verified"))


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the lines and, for every third file, one more without lines that says it is a scan."""
    lines = file_lines(spark, sf_dir).select("file", "page").distinct().select("file", "page", F.lit(True).alias("source"), F.lit(None).cast("string").alias("refusal"))
    scans = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("file"), F.lit(100_000).cast("long").alias("page"), F.lit(True).alias("source"), F.lit("scan").alias("refusal"))
    return lines.unionByName(scans)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.hits(file_lines(spark, sf_dir), text.find_pattern(QUERY))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(found(spark, sf_dir).select("file", "page", "line", "hit_no", "start", "end", "editable", "reason", "snippet"))


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    return searching.summary(found(spark, sf_dir), searching.notes(file_pages(spark, sf_dir), file_lines(spark, sf_dir)), files)


def replacing(spark: SparkSession, sf_dir: str, replacement: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Even lines have all hits picked, odd ones the first; some lines have changed, gone, or lost their page since."""
    picked = found(spark, sf_dir).withColumn("picked", (F.col("line") % 2 == 0) | (F.col("hit_no") == 0))
    now = file_lines(spark, sf_dir).where("line % 17 <> 6").withColumn("text", F.when(F.col("line") % 13 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return picked, *searching.replaced(picked, file_pages(spark, sf_dir).where("page % 5 <> 3"), now, replacement)


def replace_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(replacing(spark, sf_dir, REPLACEMENT)[1])


def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacing(spark, sf_dir, REPLACEMENT)[2]


def replace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked, statuses, _ = replacing(spark, sf_dir, "")
    return searching.file_statuses(picked, statuses)


QUERIES = {"search_hits": search_hits, "search_summary": search_summary, "replace_statuses": replace_statuses, "replaced_lines": replaced_lines, "replace_files": replace_files}
HITS = f"""{LINES},
g AS (SELECT doc_id AS file, (line_no // {PAGE})::BIGINT AS page, line_no::BIGINT AS line, text, regexp_extract_all(text, '(?i){QUERY}') AS m, string_split_regex(text, '(?i){QUERY}') AS g,
  CASE WHEN line_no % 7 = 3 THEN 'locked' WHEN line_no % 19 = 2 THEN 'turned' WHEN line_no % 11 = 5 AND line_no % 2 <> 0 THEN 'unchecked' END AS reason FROM lines),
h AS (SELECT file, page, line, text, reason, i - 1 AS hit_no, (list_sum([length(x) FOR x IN g[1:i]]) + {len(QUERY)} * (i - 1))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM g WHERE len(m) > 0)),
p AS (SELECT *, CASE WHEN page % 5 = 3 THEN 'page gone' WHEN reason IS NOT NULL THEN reason WHEN line % 17 = 6 THEN 'line gone' WHEN line % 13 = 4 THEN 'changed since the search' END AS message FROM h WHERE line % 2 = 0 OR hit_no = 0)"""
ORACLE_SQL = {
    "search_hits": f"""WITH {HITS} SELECT file, page, line, hit_no, start, start + {len(QUERY)} AS "end", reason IS NULL AS editable, reason,
CASE WHEN start > 28 THEN '…' ELSE '' END || substr(text, greatest(0, start - 28) + 1, least(length(text), start + {len(QUERY)} + 28) - greatest(0, start - 28)) || CASE WHEN start + {len(QUERY)} + 28 < length(text) THEN '…' ELSE '' END AS snippet FROM h""",
    "search_summary": f"""WITH {HITS}, c AS (SELECT file, count(*) AS n_hits, count(reason) AS n_blocked FROM h GROUP BY file)
SELECT doc_id AS file, coalesce(n_hits, 0) AS n_hits, coalesce(n_blocked, 0) AS n_blocked, (doc_id % 3 = 0)::BIGINT AS n_notes, n_hits IS NOT NULL OR doc_id % 3 = 0 AS shown FROM documents LEFT JOIN c ON c.file = doc_id""",
    "replace_statuses": f"WITH {HITS} SELECT file, page, line, hit_no, message IS NULL AS ok, message FROM p",
    "replaced_lines": f"""WITH {HITS} SELECT DISTINCT file, page, line, CASE WHEN line % 2 = 0 THEN regexp_replace(text, '(?i){QUERY}', '{REPLACEMENT}', 'g') ELSE regexp_replace(text, '(?i){QUERY}', '{REPLACEMENT}') END AS new_text FROM p WHERE message IS NULL""",
    "replace_files": f"""WITH {HITS}, s AS (SELECT file, count(*) FILTER (message IS NULL) AS n_ok, count(message) AS n_failed FROM p GROUP BY file), e AS (SELECT file, count(*) FILTER (reason IS NULL) AS n FROM h GROUP BY file)
SELECT file, coalesce(n_ok, 0) AS n_ok, coalesce(n_failed, 0) AS n_failed, n - coalesce(n_ok, 0) AS n_open FROM e LEFT JOIN s USING (file)""",
}
