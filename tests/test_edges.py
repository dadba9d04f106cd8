"""Odd inputs of searches, wrapping, edits, blank pages, copies and streams against plain Python."""

import re
import subprocess
import sys
import time

from pyspark.sql import functions as F

from pagewright.functions.scalars import running
from pagewright.operators import layout, matching, pages, text


def test_running_states(spark):
    rows = [(i, list(range(1, i + 1))) for i in (0, 1, 2, 3, 10, 101)]
    df = spark.createDataFrame(rows, "id int, v array<int>")
    got = {r["id"]: r["s"] for r in df.select("id", running(F.col("v"), F.lit(100), lambda s, x: s * 2 % 1009 + x).alias("s")).collect()}
    for i, values in rows:
        state, want = 100, []
        for x in values:
            state = state * 2 % 1009 + x
            want.append(state)
        assert got[i] == want


def test_hits_of_long_lines(spark):
    line = "é the 😀" * 40_000
    df = spark.createDataFrame([(1, line), (2, None), (3, ""), (4, "the")], "id int, text string")
    text.find_text(df.limit(1), "the").count()
    start = time.time()
    got = text.find_text(df, text.find_pattern("the")).agg(F.count("*").alias("n"), F.sum("start").alias("s"), F.sum(F.col("end").cast("long") * F.col("hit_no")).alias("e")).first()
    assert time.time() - start < 5  # it took 10 s and grew with the square
    spots = [m.span() for m in re.finditer("the", line)]
    assert (got["n"], got["s"], got["e"]) == (40_001, sum(a for a, _ in spots), sum(b * i for i, (_, b) in enumerate(spots)))


def fill(words, room, width=6.0):
    out = []
    for w in words:
        if out and (len(out[-1]) + 1 + len(w)) * width <= room + 0.25:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def test_wrapping_of_long_lines(spark):
    long = " ".join(f"w{i % 97 * 7}" for i in range(40_000))
    rows = [(1, long, 90.0), (2, "", 50.0), (3, "  ", 50.0), (4, None, 50.0), (5, "one", 1.0), (6, "a bb  ccc\tdddd", 30.0)]
    df = spark.createDataFrame(rows, "id int, text string, room double")
    start = time.time()
    got = {r["id"]: r["wrapped"] for r in matching.wrapped(df, 6.0, "room").collect()}
    assert time.time() - start < 6
    assert got == {i: None if t is None else fill(t.split(), room) for i, t, room in rows}


def test_word_places_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, 0, " a bb  ccc"), (1, 1, ""), (2, 0, "é😀 x")], "doc_id long, line_no int, text string")
    items = layout.items_of(df)
    assert [(r["page"], r["line_no"], r["seq"], r["s"], r["x"], r["w"]) for r in items.orderBy("page", "line_no", "seq").collect()] == [(1, 0, 0, "a", 47.0, 6.0), (1, 0, 1, "bb", 61.0, 12.0), (1, 0, 2, "ccc", 89.0, 18.0), (2, 0, 0, "é😀", 40.0, 12.0), (2, 0, 1, "x", 61.0, 6.0)]
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()


def test_edits_are_plain_text(spark):
    before = spark.createDataFrame([(1, r"a\Eb.c a\Eb.c", r"new.*a\Eb.c")], "page int, before string, after string")
    edits = spark.createDataFrame([(1, 1, r"a\Eb.c", "new.*"), (1, 2, "", ""), (1, 3, "zz", "nowhere")], "page int, id int, old string, new string")
    assert {r["id"]: (r["has_new"], r["old_gone"]) for r in pages.verified_edits(before, edits).collect()} == {1: (True, True), 2: (True, True), 3: (False, True)}


def test_blank_page_of_a_short_document(spark):
    rows = [(1, 0), (2, 0), (2, 1), (2, 2), (2, 3)]
    df = spark.createDataFrame([(c, t, 300.0, 400.0, 0, 0) for c, t in rows], "conv_id int, turn int, w double, h double, base_rot int, rot int")
    got = sorted((r["conv_id"], r["new_at"], r["is_blank"], r["w"]) for r in pages.with_blank(df, 2).collect())
    assert got == [(1, 0, False, 300.0), (1, 1, True, 595.28), (2, 0, False, 300.0), (2, 1, False, 300.0), (2, 2, False, 300.0), (2, 3, True, 300.0), (2, 4, False, 300.0)]


def test_copies_of_a_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(600)] + [(700, None), (701, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["first_id"], r["is_copy"]) for r in text.deduped(df).collect()}
    assert got == {i: (1, i != 1) if t == "same" else (700, i != 700) if not t else (i, False) for i, t in rows}


FOLLOW = """
import sys
from pyspark.sql import SparkSession
from pagewright.streaming import edits
home = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", home + "/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
stream = spark.readStream.schema("doc long, line long, version long, ts timestamp").parquet(home + "/in")
edits.follow(edits.edit_windows(stream), home + "/out").awaitTermination()
"""


def test_follow_starts_again_in_another_process(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, v, f"2024-01-0{v} 00:00:00") for v in range(1, 8)], "doc long, line long, version long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", FOLLOW, str(tmp_path)], capture_output=True, timeout=200)
        assert done.returncode == 0, done.stderr[-2000:]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() > 0
