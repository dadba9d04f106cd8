"""Lines that repeat across documents, dropped by per-document bitmaps (operator 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import SPACES, ascii_lower, cut, join_spread, partitions, row_key

MIN_KEY = 10
#: A line's first occurrences are taken in so many parts by document, then among the parts.
SALTS = 64


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """A row for each line whose key has min_key code points: _k1, _k2, doc_id, pos and 128 bits of the key."""
    # keys first: beside the generator they would be computed again for each line
    rows = docs.where("doc_id is not null").select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", "_k1", "_k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACES)))).where(F.length("key") >= min_key)
    return keys.select("doc_id", "_k1", "_k2", "pos", F.xxhash64(F.lit("a"), "key").alias("h1"), F.xxhash64(F.lit("b"), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def repeated_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Bitmaps of what to drop: a row (_k1, _k2, n_dropped, dropped) for each document that loses lines.

    `dropped` maps the number of a word of 64 lines to its bits (bit i: line 64 * word + i goes); words without a
    dropped line are left out, which is the compression: an absent word keeps all its lines. Texts aren't returned.

    First occurrences: each (hash, salt) is aggregated to its first document and position and its last document before it
    moves; these heads are range-partitioned by hash and sorted by hash, document and position, and a window streams
    the first of each hash. Lines then meet the hashes of two documents or more; a very common line is dealt into parts
    by its counted share of all such lines.

    Rows with a null doc_id keep all lines and count for none. Rows that repeat a doc_id are the same document.
    """
    lines = line_hashes(docs, min_key)
    heads = lines.groupBy("h1", "h2", "salt").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    heads = heads.repartitionByRange(partitions(docs.sparkSession), "h1", "h2")
    same = Window.partitionBy("h1", "h2")
    heads = heads.select("h1", "h2", F.col("first.doc_id").alias("holder"), F.row_number().over(same.orderBy("first", "salt")).alias("at"), F.max("last").over(same).alias("end"), F.sum("n").over(same).alias("n"))
    heads = cut(heads.where("at = 1 and end > holder").select("h1", "h2", "holder", "n"))
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = join_spread(lines, heads, ["h1", "h2"], "n", total, F.xxhash64("_k1", "pos")).where("doc_id > holder")
    words = gone.groupBy("_k1", "_k2", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("_k1", "_k2").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the bitmaps applied: doc_id, n_lines, n_dropped and the kept text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_key()).join(bitmaps, ["_k1", "_k2"], "left")
    texts = texts.withColumn("lines", F.split("text", "\n", -1))
    texts = texts.withColumn("dense", F.when(F.col("dropped").isNotNull(), F.transform(F.sequence(F.lit(0), F.shiftright(F.size("lines") - 1, 6)), lambda w: F.coalesce(F.try_element_at("dropped", w), F.lit(0).cast("long")))))
    kept = F.array_join(F.filter("lines", lambda _, i: F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get("dense", F.shiftright(i, 6)), i.bitwiseAND(63))) == 0), "\n")
    return texts.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = drop_lines(docs, repeated_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id > s.holder AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
