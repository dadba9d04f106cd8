"""Paragraphs against SQL and a plain walk; reading order on fixtures of columns."""

import random
import re

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import paragraphs as op
from pagewright.plans import paragraphs as plans

COLUMNS = "page string, col int, row int, x0 double, x1 double, text_x double, label_x double, y double, size double, text string, bold boolean, last_bold boolean, mark string, lead double"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


def plain(col):
    """first, last and kind of each row, one walk after another."""
    n = len(col)
    far = [max(r["x1"] for r in col if abs(r["size"] - c["size"]) < 0.15 * c["size"]) for c in col]

    def passes(s, a, q):
        row, g = col[s], col[a]["y"] - col[q]["y"]
        q, a = col[q], col[a]
        x = abs(q["x0"] - row["x0"]) < 1.5 or abs(q["x0"] - row["text_x"]) < 1.5 or row["label_x"] is not None and row["x0"] < q["x0"] < row["label_x"] + 1.5
        t = q["text"].strip()
        word = t.split()[0] if t else ""
        fits = bool(word) and a["x1"] + 0.28 * q["size"] + (q["x1"] - q["x0"]) / max(1, len(t)) * len(word) < far[s] - 0.5
        entry = bool(re.match("[A-Z]", t)) and a["x1"] < far[s] - 2 * row["size"] and not re.search(r"(?i)(,|;|-|–|&|\band|\bor|\bof|\bthe|\bwith|\bfor|\bto|\bin)\s*$", a["text"].strip())
        return not (q["mark"] or q["label_x"] is not None or q["bold"] != row["last_bold"] or g > 1.25 * row["lead"] or g < 0.5 * row["lead"] or abs(q["size"] - row["size"]) >= 0.1 * row["size"] or not x or fits or entry)

    level = lambda a, b: abs(col[a]["y"] - col[b]["y"]) < 0.4 * max(col[a]["size"], col[b]["size"])

    def walk(s):
        e = s
        while e + 1 < n and passes(s, e, e + 1):
            e += 1
        return e

    items = {}
    starts = [i for i in range(n) if col[i]["mark"]]
    ends = {}
    for s in starts:
        e = s
        while e + 1 < n and not col[e + 1]["mark"] and col[e]["y"] - col[e + 1]["y"] <= 1.3 * col[s]["lead"] and abs(col[e + 1]["x0"] - col[s]["text_x"]) < 2.5 and abs(col[e + 1]["size"] - col[s]["size"]) < 0.1 * col[s]["size"]:
            e += 1
        ends[s] = e
    for k, s in enumerate(starts):
        e, lead, near = ends[s], col[s]["lead"], False
        if k:
            p = starts[k - 1]
            gap = col[p]["y"] - col[s]["y"]
            near = col[p]["mark"] == col[s]["mark"] and gap <= max(2.6 * lead, (s - p + 1) * 1.4 * lead) and all(col[j]["y"] - col[s]["y"] <= 2.6 * lead * (s - j) + 1e-9 for j in range(p, s))
        if not near and e + 1 < n and col[e + 1]["mark"] == col[s]["mark"] and col[e]["y"] - col[e + 1]["y"] <= 2.2 * lead:
            near = True
        if e > s or near:
            items.update(dict.fromkeys(range(s, e + 1), (s, e)))
    out = []
    for i in range(n):
        if i in items:
            (s, e), kind = items[i], "item"
        else:
            s, kind = i, "para"
            while s > 0 and not col[s]["mark"] and not level(s - 1, s) and passes(s - 1, s - 1, s):
                s -= 1
            e = max(i, walk(s))
        while s > 0 and level(s - 1, s):
            s -= 1
        while e + 1 < n and level(e, e + 1):
            e += 1
        out.append((col[i]["row"], i, s, e, kind))
    return out


def test_paragraphs_match_a_plain_walk(spark):
    rng = random.Random(5)
    pages = {}
    for p in range(80):
        y, col = 800.0, []
        for k in range(rng.randrange(1, 25)):
            y -= rng.choice([14.0, 14.0, 14.0, 14.0, 15.0, 20.0, 3.0, 34.0])
            x0 = rng.choice([40.0, 40.0, 40.0, 41.0, 52.0])
            mark = rng.choice([None] * 6 + ["•@40", "-@40"])
            bold = rng.random() < 0.15
            text = rng.choice(["word after word", "Capital start of", "ends in the", "two, three;", "One", "", "and more of it"])
            size = rng.choice([10.0] * 8 + [10.6, 12.0])
            col.append({"row": k, "x0": x0, "x1": x0 + rng.choice([200.0, 250.0, 300.0, 296.0]), "text_x": x0 + (12.0 if mark else 0.0), "label_x": x0 + 40 if rng.random() < 0.05 else None, "y": y, "size": size, "text": text, "bold": bold, "last_bold": bold, "mark": mark, "lead": 14.0})
        pages[f"p{p}"] = col
    names = [c.split()[0] for c in COLUMNS.split(", ")][2:]
    df = spark.createDataFrame([(p, 0, *[r[c] for c in names]) for p, col in pages.items() for r in col], COLUMNS)
    got = sorted((r["page"], r["row"], r["i"], r["first"], r["last"], r["kind"]) for r in op.paragraphs(df).collect())
    assert got == sorted((p, *x) for p, col in pages.items() for x in plain(col))


def test_columns_are_read_one_after_the_other(spark):
    rows = [(0, 40.0, 540.0, 800.0)]  # a title across the page
    rows += [(10 + k, 40.0, 260.0, 760.0 - 14 * k) for k in range(8)] + [(30 + k, 320.0, 540.0, 760.0 - 14 * k) for k in range(8)]
    rows += [(50 + k, 40.0, 160.0, 560.0 - 14 * k) for k in range(6)] + [(70 + k, 220.0, 340.0, 560.0 - 14 * k) for k in range(6)] + [(90 + k, 400.0, 540.0, 560.0 - 14 * k) for k in range(6)]
    df = spark.createDataFrame([("p", r, x0, x1, y, 10.0) for r, x0, x1, y in reversed(rows)], "page string, row int, x0 double, x1 double, y double, size double")
    assert [r["row"] for r in op.reading_order(df, 8.0).orderBy("rank").collect()] == [r[0] for r in rows]
    assert op.reading_order(df.limit(0), 8.0).count() == 0
