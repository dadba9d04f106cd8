"""Lines told on columns of whole pages against the lines told one item after another."""

import random

import numpy as np
import pyarrow as pa
from conftest import SF

from pagewright.operators import grouping, placing
from pagewright.plans import grouping as plans

ITEMS = "page string, seq int, text string, font string, a double, b double, c double, d double, e double, f double, width double, eol boolean"


def pages_of(rng, n, plain):
    rows = []
    for p in range(n):
        x, y, q = 40.0, 700.0, rng.random()
        for k in range(rng.randrange(40)):
            words = ["word", "two words", " ", "end ", " start", "12"] if plain else ["word", " ", "  ", "", None, "हिं", "दी", "12", "end ", " start", "a ", "b  ", "\u0085", " x "]
            text = rng.choice(words)
            width = rng.choice([12.0, 15.0, 6.0]) if (text or "").strip() else rng.choice([14.0, 40.0] if plain else [3.0, 14.0, 14.0, 40.0, None])
            size = 10.0 if plain else rng.choice([10.0] * 9 + [10.1, 12.0, 0.5, float("nan")])
            turned = not plain and rng.random() < 0.05
            matrix = (0.0, size, -size, 0.0) if turned else (size, 0.0, 0.0, size)
            rows.append((None if p == 3 else f"p{p}", k, text, rng.choice(["F1"] * 8 + ["F2", "F3", "F1" if plain else None]), *matrix, x, y, width, rng.choice([True, False, False, False, False, False, None if not plain else False])))
            x += (width or 0.0) + (rng.choice([0.0, 0.0, 0.0, 2.0, 14.0]) if plain else rng.choice([0.0, 0.0, 1.0, 2.0, 14.0, -1.0, -30.0]))
            if rng.random() < 0.15 * q:
                x, y = 40.0, y - rng.choice([0.2, 14.0])
    return rows


def said(rows):
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(near(v) for v in r) for r in rows), key=repr)


def test_columns_tell_what_turns_tell(spark):
    rng = random.Random(21)
    rows = pages_of(rng, 150, True) + [(None if r[0] is None else "o" + r[0], *r[1:]) for r in pages_of(rng, 250, False) if r[0]]
    df = spark.createDataFrame(rows, ITEMS).coalesce(1)
    for odd in (None, ["F3"]):
        want = said(grouping.engine_lines(df, odd).collect())
        assert len(want) > 1_500 and said(placing.placed_lines(df, odd).collect()) == want
    assert placing.placed_lines(df.limit(0)).count() == 0


def test_plain_pages_take_no_turns(monkeypatch):
    monkeypatch.setattr(placing, "by_turns", None)
    n = 50
    v = {c: np.zeros(n) for c in placing.PLACES} | {"page": np.zeros(n, int), "font": np.arange(n) // 7, "eols": np.arange(n) // 20, "blank": np.arange(n) % 5 == 4}
    v |= {"e": np.arange(n) * 20.0, "width": np.full(n, 19.0), "ux": np.ones(n), "size": np.full(n, 10.0)}
    assert (placing.runs_of(v)["of"] >= 0).sum() == 40


def test_pages_are_whole_in_any_batches(monkeypatch):
    monkeypatch.setattr(placing, "ITEMS", 10)
    monkeypatch.setattr(placing, "page_lines", lambda t, _: iter([t.select(["page", "line", "text"])]))
    pages = [p for p, n in enumerate((1, 30, 4, 9, 1, 1, 60, 3)) for _ in range(n)]
    t = pa.RecordBatch.from_arrays([pa.array(pages), pa.array(range(len(pages)), pa.int32()), pa.array(["x"] * len(pages))], ["page", "line", "text"])
    for size in (1, 7, 13, 200):
        out = list(placing.line_step([])(iter([t.slice(k, size) for k in range(0, len(pages), size)])))
        assert [x for b in out for x in b.column(1).to_pylist()] == list(range(len(pages)))
        found = [set(b.column(0).to_pylist()) for b in out]
        assert sum(map(len, found)) == len(set(pages))


def test_words_are_neither_dealt_nor_sorted(spark):
    plan = plans.engine_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan and "Sort [" not in plan and "explode" not in plan


def test_words_of_all_parts_are_made(monkeypatch):
    monkeypatch.setattr(plans, "PART", 20)
    texts = ["a  b\n\n c ", None, "", " \n ", "x" * 50 + " y", "é ü\nz"] * 3
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(plans.text_parts(iter([docs, docs.slice(0, 0)])))
    assert len(parts) > 5 and sum((p.column(0).to_pylist() for p in parts), []) == list(range(len(texts)))
    items = [r for b in plans.text_items(iter([docs])) for r in b.to_pylist()]
    want = [(p, w, 800.0 - 14 * n) for p, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) for w in line.split(" ") if w]
    assert [(r["page"], r["text"], r["f"]) for r in items if r["text"] != " "] == want
