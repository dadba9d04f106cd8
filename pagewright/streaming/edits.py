"""Edit logs as they grow: the same aggregates on a stream of edits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.session import shared_folder


def edit_windows(edits: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(doc, start, n, lines, last) of edits (doc, line, version, ts) in windows of time; a stream forgets a window when it is `late` old. `lines` counts edited lines approximately, as streams can't count them exactly in bounded state."""
    windows = edits.withWatermark("ts", late).groupBy("doc", F.window("ts", width).alias("w"))
    told = windows.agg(F.count("*").alias("n"), F.approx_count_distinct("line").alias("lines"), F.max("version").alias("last"))
    return told.select("doc", F.col("w.start").alias("start"), "n", "lines", "last")


def follow(table: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Writes a stream of windows to Parquet files as they close; starts again from its checkpoint, by default one named by the path in the folder of spark.checkpoint.dir, which must be set then."""
    if not checkpoint and not table.sparkSession.conf.get("spark.checkpoint.dir", None):
        raise ValueError("set spark.checkpoint.dir or give a checkpoint: a new folder each time would read everything again")
    place = checkpoint or f"{shared_folder(table.sparkSession)}/follow-{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    return table.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", place).trigger(availableNow=True).start()
