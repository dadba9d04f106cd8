"""Paragraphs fold over sorted rows in tasks; phrases' ends are told from the end alone."""

import pyarrow as pa

from pagewright.operators import paragraphs


def test_columns_fold_in_sorted_tasks_and_sizes_meet_without_joins(spark):
    kinds = "page int, col int, row int, x0 double, x1 double, text_x double, label_x double, y double, size double, text string, bold boolean, last_bold boolean, mark string, lead double"
    line = lambda n, text, page=1: (page, 0, n, 40.0, 240.0 if len(text) > 12 else 100.0, 40.0, None, 800.0 - 14 * n, 10.0, text, False, False, None, 14.0)
    rows = spark.createDataFrame([line(0, "and so it goes on"), line(1, "till here"), line(2, "Another begins, of"), line(3, "The same with\t"), line(4, "Sandwith"), line(5, "Last"), line(0, "alone", None)], kinds)
    found = paragraphs.paragraphs(rows)
    assert sorted((r["row"], r["i"], r["first"], r["last"], r["kind"]) for r in found.collect()) == [(0, 0, 0, 1, "para"), (1, 1, 0, 1, "para"), (2, 2, 2, 4, "para"), (3, 3, 2, 4, "para"), (4, 4, 2, 4, "para"), (5, 5, 5, 5, "para")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "collect_list" not in plan


def test_columns_span_batches():
    names = [*[c for c in paragraphs.Row._fields if c != "far"], "new"]
    one = {"x0": 1.0, "x1": 9.0, "text_x": 1.0, "label_x": None, "size": 10.0, "fits_to": None, "above_x1": None, "bold": False, "last_bold": False, "capital": False, "above_open": False, "level": False, "item_end": None}
    rows = [{**one, "i": i, "hard": i in (0, 4), "new": i == 0} for _ in range(2) for i in range(7)]
    schema = pa.schema([(c, pa.int32() if c == "i" else pa.bool_() if isinstance(one.get(c, True), bool) else pa.float64()) for c in names])
    for size in (1, 2, 3, 7, 14):
        batches = [pa.RecordBatch.from_pylist(rows[k : k + size], schema) for k in range(0, len(rows), size)]
        got = pa.Table.from_batches(paragraphs.told(iter(batches))).select(["i", "first", "last"]).to_pylist()
        assert [tuple(r.values()) for r in got] == 2 * [(i, 0, 3) if i < 4 else (i, 4, 6) for i in range(7)]
