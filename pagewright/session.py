"""What the operators read from the session."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a new one of this machine in local mode, else an error: executors couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pagewright-")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files once they have run, which else stay until the driver happens to collect its garbage: a frame that is cut is read from its checkpoint from then on.

    A frame that runs again makes its shuffles again, so inside what is used twice is cut.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows that a task sorts or groups at a time.
ROWS = 1 << 19


def tasks_of(rows: DataFrame) -> int:
    """Over how many tasks rows are dealt so that one takes about ROWS of them, however well they compress. They are counted."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def dealt_by(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by key over tasks_of them."""
    return rows.repartition(tasks_of(rows), *key)


#: Code points of the texts that a task takes.
TEXT = 1 << 22


def dealt_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents dealt by key over tasks of about TEXT code points, three a core at least: a file of one row group is one task otherwise, and few bytes of text are much work. Their length is summed up.

    What is then told within a document or its lines needs no other exchange.
    """
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return docs.repartition(max(3 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT)), key)


#: Share of all rows from which a key is hot: 1 in so many. There are at most so many hot keys.
HOT = 1000


def join_spread(rows: DataFrame, groups: DataFrame, key: list[str], n: str, total: int, spread: Column) -> DataFrame:
    """Inner join of rows with groups (one row per key, never null, with its count n of rows) that no hot key slows: a key with more than 1 in HOT of the total is dealt by `spread` into as many parts as it has such shares.

    Only the hot keys are broadcast, HOT at most; groups repeat for the parts of hot keys, twice HOT rows at most more.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * HOT / F.lit(max(total, 1)))).cast("int")
    hot = F.broadcast(groups.select(*key, parts.alias("_parts")).where("_parts > 1"))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*key, "_salt"]).drop("_salt")
