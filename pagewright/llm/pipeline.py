"""The pipeline's stages: a training corpus from raw documents: quality, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Between
stages the rows are written as Parquet and read again, in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE_CLASS, attach, cut, whole_row_key
from pagewright.llm.decontamination import contamination
from pagewright.llm.mixing import mix, word_count
from pagewright.llm.near_copies import near_copies
from pagewright.llm.quality import THRESHOLD, fit_quality, quality_scores
from pagewright.llm.sharding import hilbert_shards, metadata
from pagewright.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is under the threshold; all columns stay, whatever their names."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality_scores(rows, model).where(F.col("score") >= THRESHOLD).select("row.*")


def near_duplicate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (5-word shingles, similarity 0.8 or more): its smallest doc_id, null last, of equal ids the smallest row key.

    Texts without words, null or not, are one group. Of rows equal in every column one stays.
    """
    groups = near_copies(docs)
    plan = groups.groupBy("root").agg(F.min("first").alias("f")).select("f._k1", "f._k2")
    return attach(docs, plan, []).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item. Null texts and texts without words stay; so do rows that repeat, if clean."""
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    return rows.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: a row for each whole pass, and one with the first words for a partial pass; in training order.

    Rows equal in every column have a place each and share its takes; rows that differ in any column keep their own.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), *whole_row_key(docs))
    plan = mix(sized).where("taken > 0").select("_k1", "_k2", "positions", "passes", "part", "size")
    rows = attach(docs, plan, ["positions", "passes", "part", "size"])
    rows = rows.select("row", "passes", "part", "size", F.posexplode("positions").alias("copy", "position"))
    start = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({SPACE_CLASS}*[^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), F.col("part").cast("int")), "")
    cut_off = (F.col("copy") >= F.col("passes")) & (F.col("part") < F.col("size"))
    rows = rows.withColumn("row", F.col("row").withField("text", F.when(cut_off, start).otherwise(F.col("row.text"))))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        rows = rows.withColumn("row", F.col("row").withField("n_chars", F.when(cut_off, F.length("row.text").cast(kind)).otherwise(F.col("row.n_chars"))))
    return rows.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the rows; they replace columns of these names. Null texts have size 8; equal rows each have their place."""
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    plan = hilbert_shards(cut(metadata(docs))).select("_k1", "_k2", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    kept = [c for c in docs.columns if c.lower() not in own]
    return attach(docs, plan, own).select(*[F.col(f"row.`{c}`") for c in kept], *own)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicate_texts),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: The fitted model and XXH64 fingerprints are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
