"""Benchmark passages in documents: a prefix-filtered set join with exact windows (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, cut, row_key

WINDOW = 10
SHINGLE = 5
#: Windows that one broadcast may hold (about 300 bytes each); a larger benchmark is joined in blocks of so many.
BROADCAST_WINDOWS = 200_000
#: Everything that isn't in a word: ASCII without digits and lower-case letters.
GAP = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    bare = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(GAP))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP_CLASS + "+"))


def shingle_hash(at: Column, size: int, array: str = "words") -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The windows of the items, once for each item: item (its id as a string), win (words), w1 and w2 (128 bits that name the window), size (of its shingles)."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window)), lambda i: F.slice("words", i + 1, window))).alias("win"))
    names = [F.xxhash64(F.lit(c), "win").alias(n) for c, n in (("a", "w1"), ("b", "w2"))]
    return rows.distinct().select("item", "win", *names, F.least(F.lit(shingle), F.size("win")).alias("size"))


def doc_positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document and word position with the hash of the shingle of each size there; and one at position -1 with none."""
    rows = docs.select("doc_id", *row_key(), F.xxhash64("text").alias("_text"), words(F.col("text")).alias("words"))
    rows = rows.select("*", F.size("words").alias("n_words"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - min(sizes, default=1)))).alias("pos"))
    if len(sizes) == 1:
        return rows.withColumn("h", F.when(F.col("pos") >= 0, shingle_hash(F.col("pos"), sizes[0]))).withColumn("size", F.lit(sizes[0]))
    some = F.array(*[F.struct(F.lit(s).alias("size"), F.when((F.col("pos") >= 0) & (F.col("pos") + s <= F.col("n_words")), shingle_hash(F.col("pos"), s)).alias("h")) for s in sizes])
    some = F.when(F.col("pos") >= 0, some).otherwise(F.array(F.struct(F.lit(0).alias("size"), F.lit(None).cast("long").alias("h"))))
    return rows.withColumn("s", F.explode(some)).select("doc_id", "_k1", "_k2", "_text", "words", "n_words", "pos", "s.size", "s.h")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document (doc_id, text): n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter item. Each window's shingles (of
    `shingle` words, fewer if the window is shorter) are ordered by rarity, counted over all documents. As the whole
    window must occur, its necessary prefix is its rarest shingle: documents are joined on that only. A join partner is
    tested by position and length (the window must fit around it) and then word by word. The matching is one pass over
    the texts, without moving them; the benchmark's prefixes are broadcast in blocks of BROADCAST_WINDOWS. Hits carry
    the name of their window; items come to the distinct (document, window) afterwards.

    Null texts and texts without words have no words and no hits. The windows of items without an id count as hits, but
    no such item is listed. Rows equal in doc_id and text count as one. Other columns are left out.
    """
    of_items = cut(item_windows(items, window, shingle))
    windows = of_items.select("win", "w1", "w2", "size").distinct()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `shingle` values at most
    within = windows.select("*", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("size"))).alias("offset"))
    within = within.withColumn("h", F.coalesce(*[F.when(F.col("size") == s, shingle_hash(F.col("offset"), s, "win")) for s in sizes], F.lit(0).cast("long")))
    n = windows.count()
    blocks = max(1, -(-n // BROADCAST_WINDOWS))
    block = F.pmod(F.xxhash64("win"), F.lit(blocks))
    positions = doc_positions(docs, sizes)
    seen = None
    for b in range(blocks):
        wanted = F.broadcast(within.where(block == b).select("size", "h").distinct())
        part = positions.join(wanted, ["size", "h"]).groupBy("size", "h").agg(F.count("*").alias("n"))
        seen = part if seen is None else seen.union(part)
    counts = seen.groupBy("size", "h").agg(F.max("n").alias("n"))
    rarest = within.join(counts, ["size", "h"], "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("r"), F.first("size").alias("size"), F.first("w1").alias("w1"), F.first("w2").alias("w2"))
    prefixes = cut(rarest.select("win", "w1", "w2", "size", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"), F.size("win").alias("len")))
    found = None
    for b in range(blocks):
        here = F.broadcast(prefixes.where(block == b))
        start = F.col("pos") - F.col("offset")
        rows = positions.join(here, ["size", "h"], "left").where((F.col("pos") == -1) | (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.coalesce("len", F.lit(0))) == F.col("win")))
        rows = rows.select("doc_id", "_k1", "_k2", "_text", "n_words", F.when(F.col("pos") >= 0, F.struct(start.alias("start"), (start + F.col("len")).alias("end"))).alias("span"), *[F.when(F.col("pos") >= 0, F.col(c)).alias(c) for c in ("w1", "w2")])
        found = rows if found is None else found.union(rows)
    found = cut(found)
    held = found.where("w1 is not null").select("_k1", "_k2", "w1", "w2").distinct().join(of_items.where("item is not null").select("w1", "w2", "item"), ["w1", "w2"])
    held = held.select("_k1", "_k2", "item").distinct().groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    per_doc = found.groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.first("_text").alias("_text"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"))
    per_doc = per_doc.join(held, ["_k1", "_k2"], "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    empty = F.struct(F.lit(0).alias("until"), F.lit(0).alias("n"))
    hit = F.aggregate("spans", empty, lambda a, s: F.struct(F.greatest(a["until"], s["end"]).alias("until"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["until"], s["start"]))).alias("n")), lambda a: a["n"])
    return per_doc.select("doc_id", "_text", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids").withColumn("contaminated", F.col("n_hit") > 0)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS size FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM windows) s WHERE i + s.size - 1 <= len(w)),
hits AS (SELECT p.doc_id, p.i, p.size, v.item FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
