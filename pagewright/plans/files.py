"""The queries of files and logs, and the SQL that checks them, on bytes made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.catalog import LINES, doc_lines, read
from pagewright.sources import files
from pagewright.streaming import edits


def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.when(k % 5 == 0, "x").when(k % 5 == 1, "ÿØÿà").otherwise("junk %PDF-1.7\n")
    tail = F.when(k % 3 == 0, "\ntrailer << /Encrypt 5 0 R >>").when(k % 7 == 0, "/Encrypt\n<<").otherwise("/Encryption")
    rows = read(spark, sf_dir, "documents").select(k, k.cast("string").alias("name"), files.latin_bytes(F.concat(head, F.coalesce("text", F.lit("")), tail)).alias("content"))
    return files.checked_files(rows).select("doc_id", "kind", "code")


def font_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bits = F.lpad(F.hex(k % 16), 4, "0")
    table = lambda tag, at: F.concat(F.lit(tag.encode().hex()), F.lit("00000000"), F.lit(at), F.lit("00000060"))
    tag = F.when(k % 4 == 0, table("cmap", "0000002C")).otherwise(table("OS/2", "0000002C"))
    font = F.concat(F.when(k % 5 == 0, "00000000").otherwise("00010000"), F.lit("0002000000000000"), table("glyf", "00000000"), tag, F.lit("00" * 8), bits)
    return read(spark, sf_dir, "part").select("p_partkey", files.font_licence(F.unhex(font)).alias("licence"))


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    turn = F.hex(k % 8 + 1)
    # two entries of a picture's directory: one of no interest, then its turn
    big = F.concat(F.lit("4D4D002A00000008" + "0002" + "0100000300000001" + "00050000" + "0112000300000001" + "000"), turn, F.lit("0000"))
    little = F.concat(F.lit("49492A0008000000" + "0200" + "0001030001000000" + "05000000" + "1201030001000000" + "0"), turn, F.lit("000000"))
    exif = F.concat(F.lit("FFD8FFE000040000FFE10040457869660000"), F.when(k % 2 == 0, big).otherwise(little))
    data = F.when(k % 3 == 0, F.lit("FFD8FFDA0000")).when(k % 5 == 0, F.lit("89504E47")).otherwise(exif)
    return read(spark, sf_dir, "part").select("p_partkey", files.picture_orientation(F.unhex(data)).cast("long").alias("turn"))


def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), (-F.col("line_no")).alias("at"), F.encode("text", "UTF-8").alias("content"))
    return files.content_strings(parts).select("page", F.length("stream").cast("long").alias("n_bytes"), F.md5(files.latin_bytes(F.col("stream"))).alias("digest"))


def edit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("line"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("ts"))
    return edits.edit_windows(log).select("doc", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", "last")


QUERIES = {"checked_files": checked_files, "font_licences": font_licences, "picture_turns": orientations, "page_streams": page_streams, "edit_windows": edit_windows}
ORACLE_SQL = {
    "checked_files": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'jpeg' ELSE 'pdf' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'invalid' WHEN doc_id % 5 > 1 AND (doc_id % 3 = 0 OR doc_id % 7 = 0) THEN 'encrypted' END AS code FROM documents""",
    "font_licences": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey % 16 END AS licence FROM part",
    "picture_turns": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 1 ELSE p_partkey % 8 + 1 END::BIGINT AS turn FROM part",
    "page_streams": f"WITH {LINES} SELECT doc_id AS page, sum(strlen(text) + 1)::BIGINT - 1 AS n_bytes, md5(string_agg(text, chr(10) ORDER BY line_no DESC)) AS digest FROM lines GROUP BY doc_id",
    "edit_windows": "SELECT user_id AS doc, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL",
}
