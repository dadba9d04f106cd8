"""Rewritten streams against a plain splice, and items that moved are where they should be."""

import random

import pytest
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import graphics, painted, rewriting
from pagewright.plans import rewriting as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def test_spans_are_spliced_from_the_right(spark):
    rng = random.Random(11)
    streams, spans, want = {}, [], {}
    for p in range(200):
        text = "".join(rng.choice("abcdé😀") for _ in range(rng.randrange(40)))
        own = {}
        for _ in range(rng.randrange(8)):
            s = rng.randrange(len(text) + 1)
            inserts = rng.random() < 0.3
            own[s, inserts] = (s, s if inserts else min(len(text), s + rng.randrange(1, 9)), rng.choice(["", "X", "YY"]), inserts)
        streams[p] = text
        spans += [(p, *x) for x in own.values()]
        out, last, n = text, len(text) + 1, 0
        for s, e, new, _ in sorted(own.values(), key=lambda x: (-x[0], x[3])):
            if e <= last:
                out, last, n = out[:s] + new + out[e:], s, n + 1
        want[p] = (out, n, len(own) - n)
    df = spark.createDataFrame(list(streams.items()), "page int, stream string")
    got = rewriting.rewritten(df, spark.createDataFrame(spans, "page int, s int, e int, text string, inserts boolean"))
    assert {r["page"]: (r["stream"], r["n_kept"], r["n_dropped"]) for r in got.collect()} == want


def test_moved_items_are_moved(spark):
    streams = spark.createDataFrame([(1, "2 0 0 4 3 3 cm 1 2 m 3 4 5 6 7 8 c 1 1 9 9 v h S /Im Do BI /W 1 ID x EI 0 0 2 2 re f")], "page int, stream string")
    objects = spark.createDataFrame([(1, "Im", "image", None, None)], "page int, name string, kind string, bounds array<double>, matrix array<double>")
    ops = painted.stream_operations(streams)
    items = graphics.page_items(ops, objects)
    new = rewriting.rewritten(streams, rewriting.shifts(items.withColumn("dy", F.lit(10.0)), ops, streams)).select("page", "stream")
    boxes = lambda s: [(r["kind"], [round(x, 3) for x in r["box"]]) for r in graphics.page_items(painted.stream_operations(s), objects).orderBy("i0").collect()]
    assert boxes(new) == [(k, [b[0], b[1] + 10, b[2], b[3] + 10]) for k, b in boxes(streams)]
    gone = rewriting.rewritten(streams, rewriting.drops(items, ops))
    left = graphics.page_items(painted.stream_operations(gone.select("page", "stream")), objects).collect()
    assert {(r["kind"], r["painted"]) for r in left} == {("path", False)}


def test_pages_are_rewritten_without_joins(spark):
    plan = plans.QUERIES["rewritten_streams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_edits_of_rows_are_shifts_and_drops(spark):
    rng = random.Random(8)
    said = ["q", "Q", "2 0 0 .5 1 3 cm", "1 1 1 1 0 0 cm", "0 .3 -.7 0 9 9 cm", "0 1 m", "4 5 l", "h", "1 2 3 4 re", "9 -1.23456 3 4 (x) re", "1 2 3 4 5 6 c", "7 8 9 1 v", "W n", "f", "S", "n", "/Im Do", "/Fm Do", "BT", "(a) Tj", "ET", "BI /W 1 ID x EI", "BI", "sh"]
    streams = [(p, " ".join(rng.choice(said) for _ in range(rng.randrange(40)))) for p in range(240)]
    streams += [(p + 240, t) for p, t in streams] + [(900, None), (901, ""), (902, "/Im Do")]
    kinds = "page long, stream string, objects array<struct<name string, kind string, bounds array<double>, matrix array<double>>>"
    df = spark.createDataFrame([(p, t, [("Im", "image", None, None), ("Fm", "form", [0.0, 0.0, 4.0, 2.5], [1.0, 0.0, 0.0, 2.0, 3.0, 0.1])]) for p, t in streams], kinds)
    up = lambda i0: F.when(F.col("page") % 5 == 0, None).otherwise((i0 % 3) * 7.125 - 7.125)
    out = lambda i0, kind: F.when(F.col("page") % 7 == 0, None).otherwise((i0 + F.col("page") % 240) % 4 == (F.when(kind == "path", 0).otherwise(1)))
    ops = painted.stream_operations(df)
    items = graphics.stream_items(df).withColumn("dy", up(F.col("i0"))).withColumn("gone", out(F.col("i0"), F.col("kind"))).cache()
    kept = F.coalesce("gone", F.lit(False))
    spans = rewriting.shifts(items.where(~kept), ops, df).unionByName(rewriting.drops(items.where(kept), ops))
    rows = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[0])
    want = rows(rewriting.rewritten(df, spans))
    assert sum(r[2] > 0 for r in want) > 200 and any(r[3] for r in want)
    assert rows(rewriting.edited(df, lambda t: up(t["i0"]), lambda t: out(t["i0"], t["kind"]))) == want


def test_numbers_are_said_alike(spark):
    rng = random.Random(3)
    found = [0.0, -0.0, 0.00005, -0.00005, 1.99995, -2.5, 1e15 + 0.5, -1e14, 1e300, float("nan"), float("inf"), 123.45, -0.1] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in found], "v double").select("v", geometry.number_text(F.col("v"))).collect()
    assert [(repr(v), rewriting.number_said(v)) for v in found] == [(repr(v), t) for v, t in got]
