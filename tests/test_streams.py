"""Edit logs as streams, files from disk, and saved résumés."""

import json

from pyspark.sql import functions as F

from pagewright.sources import files
from pagewright.streaming import edits


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    log = spark.createDataFrame([("d", f"l{i % 3}", i, f"2024-01-0{1 + i // 40} {i % 24:02d}:10:00") for i in range(100)] + [("d", "late", 200, "2024-01-09 00:00:00")], "doc string, line string, version long, ts string").withColumn("ts", F.to_timestamp("ts"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    edits.follow(edits.edit_windows(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r["doc"], r["start"]): (r["n"], r["last"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["doc"], r["start"]): (r["n"], r["last"]) for r in edits.edit_windows(log).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) == 1  # the last window is still open


def test_files_are_read_and_checked(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 \xe9\xff text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt 12 0 R")
    (tmp_path / "c.txt").write_bytes(b"plain")
    got = {r["name"]: (r["kind"], r["code"]) for r in files.checked_files(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.pdf": ("pdf", "encrypted"), "c.txt": ("other", "invalid")}
    back = files.read_files(spark, str(tmp_path), "a.pdf").select(files.latin_bytes(files.latin_text(F.col("content"))).alias("b")).first()["b"]
    assert bytes(back) == b"%PDF-1.4 \xe9\xff text"


def test_broken_bytes_have_no_result(spark):
    import zlib

    rows = spark.createDataFrame([(b"",), (b"\xff\xd8\xff\xe1",), (zlib.compress(b"said"),), (None,)], "content binary")
    got = rows.select(files.picture_orientation("content").alias("o"), files.inflated("content").alias("i"), files.font_licence(F.col("content")).alias("l")).collect()
    assert [r["o"] for r in got] == [1] * 4 and [r["i"] and bytes(r["i"]) for r in got] == [None, None, b"said", None] and not any(r["l"] for r in got)


def test_saved_resumes_drop_a_large_photo_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p" * 10), ("b", "p" * 30)], "name string, photo string")
    files.save_resumes(rows, str(tmp_path / "r"), most=20)
    saved = [json.loads(line) for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted((r["name"], r.get("photo")) for r in saved) == [("a", "p" * 10), ("b", None)]
