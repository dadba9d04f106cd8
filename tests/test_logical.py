"""Logical lines against SQL and a plain walk."""

import random

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import logical
from pagewright.plans import logical as plans

ROWS = "page int, col int, row int, x0 double, x1 double, y double, size double, bold boolean, pieces array<struct<x: double, text: string>>"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def plain(rows):
    """One row after another: (text, parts, size, gap)."""
    merged = []
    for r in sorted(rows, key=lambda r: (-r["y"], r["x0"], r["row"])):
        m = merged[-1] if merged else None
        if m and abs(m["y"] - r["y"]) <= 0.3 * max(m["size"], r["size"]):
            m["parts"].append(dict(r))
            m["size"] = max(m["size"], r["size"])
        else:
            merged.append({"y": r["y"], "size": r["size"], "parts": [dict(r)]})
    out, prev = [], None
    for m in merged:
        parts = sorted(m["parts"], key=lambda p: (p["x0"], p["row"]))
        k = 1
        while k < len(parts):
            a, b = parts[k - 1], parts[k]
            most = max(a["size"], b["size"])
            if abs(a["size"] - b["size"]) <= 0.15 * most and abs(a["y"] - b["y"]) <= 0.15 * most and b["x0"] < a["x1"] - 0.5:
                parts[k - 1 : k + 1] = [{**a, "x1": max(a["x1"], b["x1"]), "pieces": a["pieces"] + b["pieces"]}]
            else:
                k += 1
        said = [" ".join(t for _, t in sorted(p["pieces"])) for p in parts]
        out.append((" ".join(said), said, m["size"], round(prev - m["y"], 6) if prev is not None else 99.0))
        prev = m["y"]
    return out


def test_lines_match_a_plain_walk(spark):
    rng = random.Random(14)
    pages = {}
    for p in range(100):
        y, rows = 800.0, []
        for k in range(rng.randrange(1, 20)):
            y -= rng.choice([0.0, 1.0, 2.0, 3.0, 14.0])
            x0 = rng.choice([40.0, 100.0, 120.0, 300.0])
            rows.append({"row": k, "x0": x0, "x1": x0 + rng.choice([30.0, 90.0]), "y": y, "size": rng.choice([10.0, 10.0, 11.0, 16.0]), "pieces": [(x0 + 5 * i, f"w{k}{i}") for i in range(rng.randrange(1, 3))]})
        pages[p] = rows
    df = spark.createDataFrame([(p, 0, r["row"], r["x0"], r["x1"], r["y"], r["size"], False, r["pieces"]) for p, rows in pages.items() for r in rows], ROWS)
    got = {}
    for r in logical.logical_lines(df).orderBy("page", "line").collect():
        got.setdefault(r["page"], []).append((r["text"], r["parts"], r["size"], round(r["gap"], 6)))
    assert got == {p: plain(rows) for p, rows in pages.items()}
    assert logical.logical_lines(df.limit(0)).count() == 0
