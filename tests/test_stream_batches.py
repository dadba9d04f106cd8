"""Content streams parsed and followed batch by batch: pages share batches, and a page may lie in several."""

import random

import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from pagewright.operators import graphics, painted
from pagewright.plans import graphics as plans


def test_operators_of_many_pages_share_batches(spark):
    streams = spark.createDataFrame([(p, "q " * (p % 3) + "Q") for p in range(500)] + [(900, None), (901, ""), (902, "0 g " * 25_000)], "page long, stream string").coalesce(1)
    out = painted.stream_operations(streams)
    sizes = [len(b) for b in out.mapInPandas(lambda it: (b.iloc[:0].assign(n=0)[["n"]] if b.empty else b.head(1).assign(n=len(b))[["n"]] for b in it), "n long").collect()]
    assert len(sizes) < 50
    got = {r["page"]: (r["n"], r["last"]) for r in out.groupBy("page").agg(F.count("*").alias("n"), F.max("i").alias("last")).collect()}
    assert got == {**{p: (p % 3 + 1, p % 3) for p in range(500)}, 902: (25_000, 24_999)}


def test_a_page_of_several_batches_keeps_its_state(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        text = "q 2 0 0 2 1 1 cm BI /W 1 ID xx EI 0 0 3 3 re f Q /Im Do 0 0 1 1 re f BI /W 1 ID yy"
        ops = painted.stream_operations(spark.createDataFrame([(1, text), (2, "/Im Do 0 0 1 1 re f")], "page int, stream string"))
        objects = spark.createDataFrame([(1, "Im", "image", None, None)], "page int, name string, kind string, bounds array<double>, matrix array<double>")
        got = sorted((r["page"], r["i0"], r["i1"], r["kind"], r["box"]) for r in graphics.page_items(ops, objects).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    unit = [0.0, 0.0, 1.0, 1.0]
    assert got == [(1, 2, 4, "inline", [1.0, 1.0, 3.0, 3.0]), (1, 5, 6, "path", [1.0, 1.0, 7.0, 7.0]), (1, 8, 8, "image", unit), (1, 9, 10, "path", unit), (1, 11, 11, "inline", unit), (2, 1, 2, "path", unit)]


def test_streams_are_followed_where_they_lie(spark):
    assert "hashpartitioning" not in plans.page_items(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_streams_in_rows_have_the_items_of_their_operators(spark):
    rng = random.Random(4)
    said = ["q", "Q", "2 0 0 .5 1 3 cm", "3 w", "0 1 m", "4 5 l", "h", "1 2 3 4 re", "W n", "f", "S", "/Im Do", "/Fm Do", "/No Do", "BT", "(a) Tj", "ET", "BI /W 1 ID x EI", "BI", "sh", "1 0 0 m 9 l"]
    streams = [(p, " ".join(rng.choice(said) for _ in range(rng.randrange(40)))) for p in range(150)]
    streams += [(p + 150, t) for p, t in streams] + [(900, None), (901, ""), (902, "0 0 1 1 re f " * 12_000), (903, "q " * 3_000 + "0 0 1 1 re f"), (904, "/Im Do")]
    of = lambda p: None if p == 904 else [("Im", "image", None, None), ("Fm", "form", [0.0, 0.0, float(p % 4), 2.5], [1.0, 0.0, 0.0, 2.0, 3.0, 0.1]), ("Im", "form", None, None)][p % 2 :]
    kinds = "page long, stream string, objects array<struct<name string, kind string, bounds array<double>, matrix array<double>>>"
    df = spark.createDataFrame([(p, t, of(p)) for p, t in streams], kinds).coalesce(2)
    objects = df.select("page", F.posexplode("objects").alias("n", "o")).where("n = 0 or o.name <> 'Im' or page % 2 = 1").select("page", "o.*")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    want = rows(graphics.page_items(painted.stream_operations(df), objects))
    assert len(want) > 12_000 and rows(graphics.stream_items(df)) == want


def test_kept_items_are_bounded_and_go_to_their_rows(monkeypatch):
    monkeypatch.setattr(graphics, "OUT", 7)
    monkeypatch.setattr(graphics, "KEPT", 20)
    rng = random.Random(5)
    streams = ["0 0 1 1 re f " * rng.randrange(6) + rng.choice(["", "0 0 2 2 re f", "/Im Do"]) for _ in range(90)] + [None]
    objects = [rng.choice([None, '[{"name":"Im","kind":"image"}]']) for _ in streams]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(streams[a:b]), pa.array(objects[a:b])], ["page", "stream", "_json"]) for a, b in ((0, 40), (40, 40), (40, 91))]
    got = []
    for batch, first, counts, items in graphics.followed_batches(iter(batches)):
        found = [tuple(r.values()) for r in items.to_pylist()]
        for page, n in zip(batch.column(0).to_pylist()[first:], counts, strict=False):
            got.append((page, found[:n]))
            found = found[n:]
        assert not found
    plain = lambda t: [list(v) if isinstance(v, tuple) else v for v in t]
    assert [(p, [plain(t) for t in f]) for p, f in got] == [(p, [plain(t) for t in graphics.followed(painted.operations(s or ""), o)]) for p, (s, o) in enumerate(zip(streams, objects, strict=True))]
