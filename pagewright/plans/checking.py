"""The queries of judged lines, on documents' lines as lines of a page, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import checking
from pagewright.plans.catalog import LINES, doc_lines, longs


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 5 points a character and 14 a line."""
    n = F.length("text")
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("line_no").cast("long").alias("line"), "text", F.lit(40.0).alias("x"), (800.0 - 14 * F.col("line_no")).alias("y"), (40 + 5.0 * n).alias("end"), F.lit(10.0).alias("size"), F.array(F.lit("F1"), F.lit("F2")).alias("fonts"))


def painted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is painted by two runs; by the line's number they lack, are of an unknown font, reach too far, say other things or nothing."""
    lines = page_lines(spark, sf_dir)
    k, h = F.col("line") % 7, F.floor(F.length("text") / 2).cast("int")
    first, second = F.left("text", h), F.substring(F.col("text"), h + 1, F.length("text"))
    run = lambda i, x, end, known, text, said: F.struct((2 * F.col("line") + i).alias("run"), F.lit(f"F{i + 1}").alias("font"), x.alias("x"), end.alias("end"), known.alias("known"), F.when(k == 5, None).otherwise(said).alias("text"), F.length(checking.bare(text)).alias("codes"))
    both = F.array(run(0, F.col("x"), F.col("x") + 5.0 * h, k != 2, first, F.when(k == 1, F.concat(F.lit("x"), first)).otherwise(first)), run(1, F.col("x") + 5.0 * h, F.col("end") + F.when(k == 3, 20.0).otherwise(0.0), F.lit(True), second, second))
    runs = lines.where(k != 4).select("page", "y", F.explode(both).alias("r")).select("page", "r.run", "r.font", F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), "r.x", "y", "r.end", "r.known", "r.text", "r.codes")
    return longs(checking.painted_by(lines, runs).select("page", "line", "ok", "reason", F.size("runs").alias("n_runs")).withColumn("n_runs", F.when(F.col("ok"), F.col("n_runs"))))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line") % 11
    text = F.when(k == 5, F.lit("")).when(k == 6, F.concat("text", F.lit("�"))).when(k == 7, F.concat("text", F.lit("שלום"))).otherwise(F.col("text"))
    lines = page_lines(spark, sf_dir).select(
        "page", "line", text.alias("text"), F.when(k == 4, "Kruti Dev 010").otherwise("Helvetica").alias("font"), (k == 1).alias("vertical"), (k == 3).alias("type3"), F.lit(10.0).alias("a"), F.when(k == 2, 3.0).otherwise(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(10.0).alias("d"), "size",
        F.when(F.col("line") % 2 == 0, F.array(F.lit("Kruti Dev"))).otherwise(F.array().cast("array<string>")).alias("readable"),
    )
    return checking.classified(lines).select("page", "line", "kind", "editable", "verify")


def arrived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is to move; every third one's item stands 10 points off, another third's has the first half of the text."""
    lines = page_lines(spark, sf_dir)
    k, h = F.col("line") % 3, F.floor(F.length("text") / 2).cast("int")
    moves = lines.select("page", "line", "text", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"), "size")
    items = lines.select("page", F.when(k == 2, F.left("text", h)).otherwise(F.col("text")).alias("text"), (F.col("x") + F.when(k == 1, 10.0).otherwise(2.0)).alias("x"), (F.col("y") - 3).alias("y"))
    return checking.arrived(moves, items)


QUERIES = {"painted_lines": painted_lines, "line_kinds": line_kinds, "arrived_lines": arrived_lines}
ORACLE_SQL = {
    "painted_lines": rf"""WITH {LINES}, r AS (SELECT doc_id AS page, line_no::BIGINT AS line, CASE WHEN length(text) = 0 OR line_no % 7 = 4 THEN 'not-found' WHEN line_no % 7 = 2 THEN 'unknown-font' WHEN line_no % 7 = 3 THEN 'shared-run' WHEN line_no % 7 = 1 THEN 'text-mismatch' END AS reason FROM lines)
SELECT page, line, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN 2 END::BIGINT AS n_runs FROM r""",
    "line_kinds": rf"""WITH {LINES}, k AS (SELECT doc_id AS page, line_no::BIGINT AS line, ['plain', 'vertical', 'turned', 'drawn', 'legacy', 'symbol', 'unreliable', 'script', 'plain', 'plain', 'plain'][line_no % 11 + 1] AS kind FROM lines)
SELECT page, line, kind, kind = 'plain' OR kind = 'legacy' AND line % 2 = 0 AS editable, CASE WHEN kind = 'legacy' AND line % 2 = 0 THEN 'legacy' END AS verify FROM k""",
    "arrived_lines": rf"""WITH {LINES}, b AS (SELECT doc_id AS page, line_no::BIGINT AS line, regexp_replace(text, '\s+', '', 'g') AS want, regexp_replace(left(text, length(text) // 2), '\s+', '', 'g') AS half FROM lines)
SELECT page, line, want = '' OR line % 3 = 0 OR line % 3 = 2 AND half <> '' AS ok FROM b""",
}
