"""Entries of sections against their SQL and against a plain loop over random lines."""

import random
import re

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import entries
from pagewright.plans import entries as plans

LINES = "doc string, at int, text string, bold boolean, bullet boolean, gap double, size double"
TEXTS = [
    "Acme Works, 2014 - 2016", "Senior Engineer", "• Built things.", "and more of it", "Example Fintech", "Diploma of Design 2012", "Wrote reports.", "2014: did so", "•", "Project Atlas", "Role at Firm, Jan 2019 – Present", "(with others)", "Ends here;",
    "Class of 2011", "- dash item", "A very long line that says nothing of use to anyone but goes on and on until it is longer than ninety characters", "", "Lead, 03/2018 to 11/2020",
]


def dates(t):
    m = re.search(r"\b((?:Jan )?(?:19|20)\d\d|\d\d/\d{4})\s*(?:-|–|to)\s*((?:19|20)\d\d|Present|\d\d/\d{4})", t)
    if m:
        return "range"
    return "single" if re.search(r"(?:19|20)\d\d", t) else None


def plain(lines, kind):
    """The rules one line after another."""
    out, pending, inside = [], False, False
    for at, text, bold, bullet, gap, size in lines:
        if re.fullmatch(r"\s*[•–-]\s*", text):
            pending = True
            continue
        item = bullet or pending or bool(re.match(r"\s*(?:[•–-]|\(?\d{1,2}[.)])\s*", text))
        if pending:
            text = "• " + text
        pending, cont = False, False
        if item:
            inside = True
        elif inside and not bold and dates(text) != "range" and gap < 2 * size and (re.match(r"[a-z(]", text.strip()) or not re.search(r"[.;!?]$", out[-1]["t"].strip())):
            cont = True
        else:
            inside = False
        out.append({"at": at, "t": text, "bold": bold, "item": item, "cont": cont})
    for x in out:
        rest = re.sub(r"[^A-Za-z]", "", re.sub(r"(?:Jan )?(?:19|20)\d\d\s*(?:-|–)\s*(?:(?:19|20)\d\d|Present)|\d\d/\d{4} to \d\d/\d{4}", "", x["t"], count=1))
        note = re.match(r"(?i)\s*(?:19|20)\d\d\s*[:\-–]?\s+[a-z]", x["t"])
        d = dates(x["t"])
        x["d"], x["hdr"] = d, bool(d and not x["item"] and not x["cont"] and (d == "range" or re.search(r"(?:19|20)\d\d$", x["t"].strip())) and not note and len(rest) >= 3 and len(x["t"]) <= 110)
    groups, told = [], []
    year = lambda t: bool(re.search(r"\b(?:19|20)\d\d\b", t))
    for i, x in enumerate(out):
        cur = groups[-1] if groups else None
        t, nx, free = x["t"], out[i + 1 : i + 3], not x["item"] and not x["cont"]
        first = next((k for k, q in enumerate(nx) if q["hdr"]), None)
        title = free and not x["d"] and len(t) < 80 and (x["bold"] or bool(re.search(entries.TITLE, t))) and first is not None and not any(q["item"] for q in nx[:first])
        school = kind == "education" and free and year(t) and len(re.sub("[^A-Za-z]", "", t)) >= 6 and not (cur and len(cur["l"]) == 1 and not year(cur["l"][0]["t"]))
        project = kind == "projects" and free and bool(nx) and not nx[0]["bold"] and len(t) < 90 and not re.search(r"[.,;:]$", t.strip()) and (x["bold"] or i > 0 and bool(re.search(r"[.!?]$", out[i - 1]["t"].strip())) and len(t) < 70)
        name = not title and kind != "projects" and free and not x["d"] and bool(nx) and nx[0]["hdr"] and len(t) < 90 and bool(re.match("[A-Z0-9]", t.strip())) and not re.search(r"[.,;:!?]$", t.strip()) and (cur is None or cur["d"])
        waits = cur and (cur["o"] or len(cur["l"]) == 1 and kind == "work" and not cur["l"][0]["item"] and len(cur["l"][0]["t"]) < 90) and not cur["d"] and len(cur["l"]) <= 2
        starts = cur is None or title or project or name or school and any(year(q["t"]) for q in cur["l"]) or x["hdr"] and not waits
        gives = bool(x["hdr"] or school and x["d"]) if starts else bool(x["hdr"] and not cur["d"])
        if starts:
            groups.append({"l": [x], "d": gives, "o": title or name})
        else:
            cur["l"].append(x)
            cur["d"] = cur["d"] or gives
        told.append((x["at"], len(groups) - 1, bool(starts), gives))
    return told


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("kind", ["work", "education", "projects"])
def test_entries_match_a_plain_loop(spark, kind):
    rng = random.Random(9)
    docs = {f"d{k}": [(at, rng.choice(TEXTS), rng.random() < 0.3, rng.random() < 0.1, rng.choice([12.0, 14.0, 40.0]), 10.0) for at in range(rng.randrange(40))] for k in range(60)}
    df = spark.createDataFrame([(d, *x) for d, lines in docs.items() for x in lines], LINES)
    got = sorted((r["doc"], r["at"], r["entry"], r["opens"], r["gives"]) for r in entries.entry_lines(df, kind).collect())
    assert got == sorted((d, *x) for d, lines in docs.items() for x in plain(lines, kind))


def test_titles(spark):
    lines = [("Senior Engineer", True), ("Acme Ltd, Jan 2019 – Present IST", False), ("• Built things.", False), ("Beta Labs", False), ("Analyst 2014 - 2016", False), ("Chief Cook at Diner 2010", False)]
    df = spark.createDataFrame([("d", i, t, b, False, 14.0, 10.0) for i, (t, b) in enumerate(lines)], LINES)
    got = [(r["position"], r["name"], r["start"], r["end"], r["confidence"]) for r in entries.entry_titles(entries.entry_lines(df)).orderBy("entry").collect()]
    assert got == [("Senior Engineer", "Acme Ltd", "2019-01", "", 0.85), ("Analyst", "Beta Labs", "2014", "2016", 0.85), ("Chief Cook", "Diner", "", "2010", 0.85)]


def test_empty_and_null_lines(spark):
    df = spark.createDataFrame([("d", 0, None, None, None, 14.0, 10.0), ("d", 1, "•", False, False, 14.0, 10.0)], LINES)
    assert [(r["at"], r["entry"]) for r in entries.entry_lines(df).collect()] == [(0, 0)]
    assert entries.entry_lines(df.limit(0)).count() == 0
