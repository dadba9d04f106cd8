"""Reachability and merging over whole tables, against plain Python."""

import json

from conftest import SF

from pagewright.plans import catalog, reading


def test_reachable_walks_all_events(spark):
    edges = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "props").collect():
        edges.setdefault(r["user_id"], set()).add(json.loads(r["props"])["k"])
    seen, front = {1, 2, 3}, [1, 2, 3]
    while front:
        new = {int(b) for b in edges.get(front.pop(), ())} - seen
        seen |= new
        front += new
    got = [r["id"] for r in catalog.QUERIES["reachable_all_events"](spark, SF).collect()]
    assert sorted(got) == sorted(seen)


def test_merge_appends_every_page(spark):
    rows = [(r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    last = {}
    for c, t in rows:
        last[c] = max(t, last.get(c, t))
    want = [(c, t, t) for c, t in rows] + [(c, t, t + 1 + last[c]) for c, t in rows]
    got = [tuple(r) for r in reading.QUERIES["merge_all_pages"](spark, SF).select("conv_id", "turn", "new_at").collect()]
    assert sorted(got) == sorted(want)
