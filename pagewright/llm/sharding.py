"""Shards along a Hilbert curve over document metadata (operator 9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import cut, join_spread, ranged, whole_row_key

BITS = 5
SHARDS = 24
#: Distinct (lang, source) pairs up to which their places on the axes are broadcast; beyond it they are joined by key.
BROADCAST_PAIRS = 100_000


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """The Hilbert index of integer coordinates in 0 to 2**bits - 1: rotations undone bit by bit from the highest, then the Gray code, then the bits interleaved.

    The state is the array of coordinates, bound by the fold, so that the expression stays small wherever it is pushed.
    """
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        low, mine, first = step["q"] - 1, F.get(x, step["i"]), F.get(x, F.lit(0))
        inverted = mine.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, first.bitwiseXOR(F.when(inverted, low).otherwise(swap))).when((j == step["i"]) & ~inverted, v.bitwiseXOR(swap)).otherwise(v))

    def interleave(x: Column) -> Column:
        gray = [F.get(x, F.lit(0))]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(x, F.lit(i))))
        turn = F.lit(0)
        for b in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(gray[-1].bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        index = F.lit(0)
        for i, g in enumerate(gray):
            for b in range(bits):
                index = index + F.shiftleft(F.shiftright(g.bitwiseXOR(turn), b).bitwiseAND(1), b * n + n - 1 - i)
        return index

    return F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), undo, interleave)


def axis(counts: DataFrame, value: str, name: str, bits: int = BITS) -> DataFrame:
    """The place of each distinct value on an axis: the share of rows before it, quantised. One row per value is sorted; null comes last."""
    by = Window.partitionBy(F.lit(1)).orderBy(F.col(value).asc_nulls_last())
    out = counts.groupBy(value).agg(F.sum("n").alias("n"))
    before, every = F.sum("n").over(by) - F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.select(value, F.floor(before * (1 << bits) / every).cast("int").alias(name))


def hilbert_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts rows (doc_id, lang, source, size, _text, _k1, _k2) on the curve and cuts it: adds shard, slot and _h. Law: row counts at most one apart.

    The dimensions are source, language and the logarithm of the size, up to the 2 GiB that a text can have. Equal texts
    (_text, a hash) stand together, with the metadata of their smallest doc_id. The order is (curve index, text hash,
    doc_id, row key).

    The running number is taken in two bounded steps: counts per range of the order, and a row number within a range.
    So no task holds the table, a hot curve index or a hot text; a hot text meets its group in several parts.
    Nulls: a null lang, source or doc_id is a value of its own; a null text has size 8. Empty tables give no rows.
    Values of lang and source are sorted in one task: they are few.
    """
    total = rows.count()
    pairs = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))
    lang, source = axis(pairs, "lang", "_l").withColumnRenamed("lang", "_lang"), axis(pairs, "source", "_s").withColumnRenamed("source", "_source")
    places = pairs.join(lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(source, F.col("source").eqNullSafe(F.col("_source")))
    places = places.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_l", "_s")
    if pairs.count() <= BROADCAST_PAIRS:
        places = F.broadcast(places)
    groups = rows.groupBy("_text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "lang", "source")).alias("_of"), F.count("*").alias("_copies"), F.max("size").alias("_size"))
    groups = groups.join(places, F.col("_of.lang").eqNullSafe(F.col("_lang")) & F.col("_of.source").eqNullSafe(F.col("_source")))
    steps = (1 << BITS) / 28.01  # of log2(size) from 3, an empty text, to 31
    groups = groups.withColumn("_b", F.least(F.lit((1 << BITS) - 1), F.floor((F.log2(F.col("_size").cast("double")) - 3) * steps)).cast("int"))
    groups = cut(groups.select("_text", hilbert_index([F.col("_s"), F.col("_l"), F.col("_b")]).alias("_h"), "_copies"))
    placed = join_spread(rows, groups, ["_text"], "_copies", total, F.xxhash64("doc_id", "_k1")).drop("_copies")
    order = [F.col("_h"), F.col("_text"), F.col("doc_id").asc_nulls_last(), F.col("_k1"), F.col("_k2")]
    placed = ranged(placed, *order)
    counts = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    firsts = counts.select("_cell", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_cell")) - F.col("_n")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_cell").orderBy(*order, "_t"))
    out = placed.join(F.broadcast(firsts), "_cell").withColumn("_rank", F.col("_first") + number - 1)
    out = out.withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)"))
    first_of_shard = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("_rank") - first_of_shard).cast("long"))


def metadata(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_text"), *whole_row_key(docs),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    rows = cut(metadata(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")))
    return hilbert_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_h").alias("curve"))
