"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import cut

#: White space of the word and line rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words between white space; an empty array for null, empty or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that name a row by its id and whole text; equal rows share them. Never null, so plain equality joins on them."""
    return [
        F.xxhash64(F.lit("a"), doc_id, text).alias("_k1"),
        F.xxhash64(F.lit("b"), text, doc_id).alias("_k2"),
    ]


def whole_row_key(df: DataFrame) -> list[Column]:
    """128 bits that name a row by all its columns, null told from absent; rows equal in every column share them. Never null."""
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    each = [x for c in plain for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit("a"), *each).alias("_k1"), F.xxhash64(F.lit("b"), *each[::-1]).alias("_k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a range, and how many ranges there are at most.
ROWS_A_RANGE, MOST_RANGES = 20_000, 10_000
#: Share of all rows from which a key is hot: 1 in so many. There are at most so many hot keys.
HOT = 1000


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in ranges of about ROWS_A_RANGE by the order, with _cell, the number of the range, and _t, which tells equal rows apart.

    Ranges come from a sample of the rows, so no key, however hot, and no repeated row fills one. Both frames are cut:
    ranges and numbers stay as they are if an executor is lost.
    """
    rows = cut(rows.withColumn("_t", F.monotonically_increasing_id()))
    n = min(MOST_RANGES, max(1, -(-rows.count() // ROWS_A_RANGE)))
    return cut(rows.repartitionByRange(n, *order, F.col("_t")).withColumn("_cell", F.spark_partition_id()))


def join_spread(rows: DataFrame, groups: DataFrame, key: list[str], n: str, total: int, spread: Column) -> DataFrame:
    """Inner join of rows with groups (one row per key, never null, with its count n of rows) that no hot key slows: a key with more than 1 in HOT of the total is dealt by `spread` into as many parts as it has such shares.

    Only the hot keys are broadcast, HOT at most; groups repeat for the parts of hot keys, twice HOT rows at most more.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * HOT / F.lit(max(total, 1)))).cast("int")
    hot = F.broadcast(groups.select(*key, parts.alias("_parts")).where("_parts > 1"))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*key, "_salt"]).drop("_salt")


def attach(docs: DataFrame, plan: DataFrame, values: list[str]) -> DataFrame:
    """Brings the plan's values to the rows of docs: column `row` holds the whole input row, beside `values`.

    plan has _k1 and _k2 of whole_row_key(docs) and a row for each row wanted. Rows equal in every column are one before
    they meet the plan's rows, so each of these gets its own copy, whichever it is.
    """
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *whole_row_key(docs)).groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return left.join(plan.select("_k1", "_k2", *values), ["_k1", "_k2"]).select("row", *values)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): a row (node, root) for each node in an edge; root is the smallest.

    Large-star and small-star steps (each a groupBy and a join, a reliable checkpoint after each round) until the edges
    are stars. Edges stay on the cluster; only a count and a checksum come to the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(size) or not size[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a")).distinct()
        before = tuple(size)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()  # each larger neighbour to the least
        # a is now the smaller end: each node's smaller neighbours, and itself, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = cut(small)
