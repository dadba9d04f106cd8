"""Document fingerprints by winnowing (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import let
from pagewright.llm.common import ascii_lower, cut, ranged, row_key

#: Words of a gram, and grams of a window: two texts that share GRAM + WINDOW - 1 consecutive words share a selected gram.
GRAM, WINDOW = 5, 8
#: A word is a run without white space; of a longer run each so many code points are one, so that texts without spaces have words.
LONGEST_WORD = 16
WORD = rf"[^\x20\x09-\x0D]{{1,{LONGEST_WORD}}}"
#: The rolling hash is a polynomial of the words' hashes in BASE, modulo MODULUS; no step leaves 63 bits.
BASE, MODULUS = 10_007, 2**48 - 59
#: Grams are ordered by the upper 33 bits of their hash, then from the right: both in one number with 30 bits of position.
DROPPED, PLACES = 15, 2**30


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """The hash of each run of `gram` consecutive words; of all words, if they are fewer; none, if there are none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    hashes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS)))

    def rolled(t: Column) -> Column:
        def at(i: Column) -> Column:
            h = F.get(t, i)
            for j in range(1, gram):
                h = (h * BASE + F.get(t, i + j)) % MODULUS
            return h

        whole = F.array(F.aggregate(t, F.lit(0).cast("long"), lambda h, x: (h * BASE + x) % MODULUS))
        return F.when(F.size(t) >= gram, F.transform(F.sequence(F.lit(0), F.size(t) - gram), at)).when(F.size(t) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, rolled)


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Struct (hash, pos) of arrays: of each window of consecutive grams the one with the least hash, the rightmost of equal ones, each once, in order; pos counts words from 0.

    Fewer grams than a window are one window. Everything is linear in the text.
    """

    def chosen(h: Column) -> Column:
        keys = F.transform(h, lambda x, p: F.shiftright(x, DROPPED) * PLACES + (PLACES - 1 - p))

        def least(v: Column) -> Column:
            width = F.least(F.lit(window), F.size(v))
            return F.when(F.size(v) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - width + 1), lambda i: F.array_min(F.slice(v, i, width))))).otherwise(F.array().cast("array<bigint>"))

        places = F.transform(let(keys, least), lambda v: (PLACES - 1 - v.bitwiseAND(PLACES - 1)).cast("int"))
        return let(places, lambda p: F.struct(F.transform(p, lambda i: F.get(h, i)).alias("hash"), p.alias("pos")))

    return let(gram_hashes(text, gram), chosen)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints, of all their hashes: 1 if both have none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def digest(print_: Column) -> Column:
    """A fingerprint as a string: sha256 of hash:pos, comma-joined."""
    return F.sha2(F.array_join(F.zip_with(print_["hash"], print_["pos"], lambda h, p: F.concat_ws(":", h.cast("string"), p.cast("string"))), ","), 256)


def neighbours(docs: DataFrame) -> DataFrame:
    """Of each distinct (doc_id, text): doc_id, k1 and k2 that name it, n (code points), copies, and n1, n2 that name the next by falling doc_id (null last, then by name); after the last comes the first.

    Only names and lengths move. The order is cut into ranges of bounded size; a range's last row takes the first row
    of the next range, of which there are MOST_RANGES at most.
    """
    rows = docs.select("doc_id", *row_key(), F.length(F.coalesce("text", F.lit(""))).alias("n")).groupBy(F.col("_k1").alias("k1"), F.col("_k2").alias("k2")).agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    within = Window.partitionBy("_cell").orderBy(*order)
    rows = ranged(rows, *order).withColumn("after", F.lead(F.struct("k1", "k2")).over(within)).withColumn("at", F.row_number().over(within))
    rows = cut(rows)
    heads = rows.where("at = 1").select("_cell", F.struct("k1", "k2").alias("head"))
    along = Window.orderBy("_cell")  # a row for each range
    heads = heads.select("_cell", F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("turn"))
    after = F.coalesce("after", "turn")
    return rows.join(F.broadcast(heads), "_cell").select("doc_id", "k1", "k2", "n", "copies", after["k1"].alias("n1"), after["k2"].alias("n2"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint (structs of winnowed()), near_edited, near_next.

    The edited text has its last third replaced by the start of the next document. A text goes to its name once; there
    each next document gives what its neighbour asks for: the first code points, and the hashes of its fingerprint. These
    go to the neighbour's name, where the same texts are read again.

    Null texts are empty and have an empty fingerprint; two empty ones are alike (1). Rows equal in doc_id and text are one
    document in the order and have a row each in the result. A null doc_id comes last. A document alone is its own
    neighbour. An empty table gives no rows. Other columns are left out.
    """
    spots = cut(neighbours(docs))
    repeated = not spots.where("copies > 1").isEmpty()
    texts = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    if repeated:
        texts = texts.dropDuplicates(["_k1", "_k2"])
    texts = texts.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    cut_off = F.floor(F.col("n") / 3).cast("int")
    asked = spots.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("r1"), F.col("k2").alias("r2"), "doc_id", "n", cut_off.alias("m"), "copies")
    given = texts.join(asked, ["k1", "k2"]).select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "doc_id", "n", "m", "copies", F.substring("text", F.lit(1), F.col("m")).alias("piece"), winnowed(F.col("text"))["hash"].alias("next"))
    both = texts.join(given, ["k1", "k2"]).select("doc_id", "n", "copies", "text", "next", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("m")), F.col("piece")).alias("edited"))
    prints = both.select("doc_id", "n", "copies", "next", F.sha2("edited", 256).alias("edited_sha256"), winnowed(F.col("text")).alias("fingerprint"), winnowed(F.col("edited")).alias("edited_fingerprint"))
    out = prints.select("doc_id", F.col("n").cast("long").alias("n_chars"), "copies", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint.hash"), F.col("edited_fingerprint.hash")).alias("near_edited"), likeness(F.col("fingerprint.hash"), F.col("next")).alias("near_next"))
    if repeated:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.drop("copies")


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", digest(F.col("fingerprint")).alias("fingerprint"), digest(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
