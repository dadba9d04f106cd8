"""Line grouping against SQL and against plain loops over random items."""

import math
import random
import re

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import grouping
from pagewright.plans import grouping as plans

ITEMS = "page string, seq int, text string, font string, a double, b double, c double, d double, e double, f double, width double, eol boolean"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def plain(items, odd=()):
    """Runs, chains and joined words, one after another."""
    raw, cur, wide = [], None, None
    for text, font, a, b, c, d, e, f, width, eol in items:
        size = math.hypot(c, d)
        if not text or size < 1:
            if eol:
                cur = wide = None
            continue
        if not text.strip() and width > size:
            wide, cur = cur or wide, None
            continue
        same = lambda r: r["font"] == font and abs(size - r["size"]) < 0.02 * size and abs(b - r["b"]) < 0.02 * size and abs(c - r["c"]) < 0.02 * size  # noqa: B023, E731
        place = lambda r: ((e - r["e"]) * r["u"][0] + (f - r["f"]) * r["u"][1], -(e - r["e"]) * r["u"][1] + (f - r["f"]) * r["u"][0])  # noqa: B023, E731
        if cur:
            along, off = place(cur)
            if same(cur) and abs(off) < 0.2 * size and along >= cur["w"] - 0.35 * size and along - cur["w"] <= 1.1 * size:
                if along - cur["w"] > 0.12 * size and not re.search(r"\s$", cur["t"]) and not re.match(r"\s", text):
                    cur["t"] += " "
                cur["t"] += text
                cur["w"] = max(cur["w"], along + width)
                if eol:
                    cur = None
                continue
        if not text.strip():
            if eol:
                cur = wide = None
            continue
        n = math.hypot(a, b) or 1
        cur = {"font": font, "e": e, "f": f, "b": b, "c": c, "u": (a / n, b / n), "size": size, "t": text, "w": width, "prev": None, "fonts": [font]}
        if wide:
            along, off = place(wide)
            if same(wide) and abs(off) < 0.2 * size and along > wide["w"]:
                cur["prev"] = wide
            wide = None
        raw.append(cur)
        if eol:
            cur = None
    out, k = [], 0
    while k < len(raw):
        m = k + 1
        while m < len(raw) and raw[m]["prev"] is not None:
            m += 1
        chain = raw[k:m]
        gaps = [(y["e"] - x["e"]) * x["u"][0] + (y["f"] - x["f"]) * x["u"][1] - x["w"] for x, y in zip(chain, chain[1:], strict=False)]
        head = chain[0]
        if gaps and max(gaps) <= (3 if len(gaps) > 1 else 1.5) * head["size"] and max(gaps) - min(gaps) <= max(0.6, 0.12 * max(gaps)):
            for y in chain[1:]:
                head["t"] = head["t"].rstrip() + " " + y["t"].lstrip()
                head["w"] = (y["e"] - head["e"]) * head["u"][0] + (y["f"] - head["f"]) * head["u"][1] + y["w"]
            out.append(head)
        else:
            out += chain
        k = m
    indic, n = lambda t: bool(re.search("[ऀ-ൿ]", t)), 0
    while n + 1 < len(out):
        x, y = out[n], out[n + 1]
        gap, sz = y["e"] - (x["e"] + x["w"]), x["size"]
        letters = (indic(x["t"]) or indic(y["t"])) and (indic(x["t"]) or not re.search("[A-Za-z]", x["t"])) and (indic(y["t"]) or not re.search("[A-Za-z]", y["t"]))
        flat = all(abs(v) <= 0.02 * sz for r in (x, y) for v in (r["b"], r["c"]))
        if x["font"] in odd or y["font"] in odd or not letters or abs(y["size"] - sz) > 0.05 * sz or abs(y["f"] - x["f"]) > 0.05 * sz or not flat or gap < -0.2 * sz or gap > 0.35 * sz:
            n += 1
            continue
        if gap > 0.12 * sz and not re.search(r"\s$", x["t"]) and not re.match(r"\s", y["t"]):
            x["t"] += " "
        x["t"] += y["t"]
        x["w"] = max(x["w"], y["e"] + y["w"] - x["e"])
        x["fonts"] = x["fonts"] + y["fonts"]
        out.pop(n + 1)
    return [(r["t"].rstrip(), round(r["e"], 6), round(r["f"], 6), round(r["w"], 6), sorted(set(r["fonts"]))) for r in out if r["t"].strip()]


def test_lines_match_plain_loops(spark):
    rng = random.Random(10)
    pages = {}
    for p in range(150):
        x, y, items = 40.0, 700.0, []
        for _ in range(rng.randrange(30)):
            text = rng.choice(["word", "two words", " ", "  ", "", "हिं", "दी", "12", "end ", " start"])
            width = rng.choice([12.0, 15.0, 6.0]) if text.strip() else rng.choice([3.0, 14.0, 14.0, 40.0])
            size = rng.choice([10.0] * 6 + [10.1, 12.0, 0.5])
            turned = rng.random() < 0.05
            items.append((text, rng.choice(["F1", "F1", "F1", "F2", "F3"]), *((0.0, size, -size, 0.0) if turned else (size, 0.0, 0.0, size)), x, y, width, rng.random() < 0.15))
            x += width + rng.choice([0.0, 0.0, 1.0, 2.0, 14.0, -1.0])
            if rng.random() < 0.2:
                x, y = 40.0, y - rng.choice([0.2, 14.0])
        pages[f"p{p}"] = items
    df = spark.createDataFrame([(p, k, *i) for p, items in pages.items() for k, i in enumerate(items)], ITEMS)
    got = sorted((r["page"], r["text"], round(r["x"], 6), round(r["y"], 6), round(r["width"], 6), sorted(r["fonts"])) for r in grouping.engine_lines(df, ["F3"]).collect())
    assert len(got) > 300 and got == sorted((p, *x) for p, items in pages.items() for x in plain(items, ("F3",)))


def test_justified_lines_join_and_cells_do_not(spark):
    made = {"even": [20.0, 20.0, 20.0], "cells": [20.0, 20.0, 20.0]}
    items = []
    for p, gaps in made.items():
        x = 0.0
        for k, g in enumerate([*gaps, 0.0]):
            items.append((p, 2 * k, f"w{k}", "F", 10.0, 0.0, 0.0, 10.0, x, 0.0, 10.0, False))
            g = g + 10 * k if p == "cells" else g
            items.append((p, 2 * k + 1, " ", "F", 10.0, 0.0, 0.0, 10.0, x + 10, 0.0, g, False))
            x += 10 + g
    df = spark.createDataFrame(items, ITEMS)
    got = sorted((r["page"], r["text"]) for r in grouping.engine_lines(df).collect())
    assert got == [("cells", "w0"), ("cells", "w1"), ("cells", "w2"), ("cells", "w3"), ("even", "w0 w1 w2 w3")]
    assert grouping.engine_lines(df.limit(0)).count() == 0


def test_runs_stream_by_page_and_no_page_is_one_row(spark):
    """A page's items and lines come one after another: no array holds a page, and a null page is a page too."""
    rows = [(p, k, f"w{k}", "F", 10.0, 0.0, 0.0, 10.0, 30.0 * k, 0.0, 10.0, False) for p in ("a", None) for k in range(25_000)]
    df = spark.createDataFrame(rows, ITEMS)
    found = grouping.engine_lines(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "mapinarrow" in plan.lower() and "aggregate(" not in plan.lower().replace("objecthashaggregate", "")
    assert found.count() == 50_000 and found.where("page is null").count() == 25_000
