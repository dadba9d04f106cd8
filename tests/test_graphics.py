"""The graphics state along content streams against a plain loop, on random streams."""

import math
import random

import pytest
from conftest import SF, rows_of, rows_of_sql

from pagewright.operators import graphics, painted
from pagewright.plans import graphics as plans

OBJECTS = {"Im": ("image", None, None), "Fm": ("form", [0.0, 0.0, 10.0, 4.0], [2.0, 0.0, 0.0, 1.0, 3.0, 0.0])}


def around(points):
    return [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]


def plain(ops):
    """One operator after another: (kind, i0, i1, box, clip, clips, line)."""
    mul = lambda m, n: [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]
    on = lambda m, ps: [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in ps]
    meet = lambda a, b: b if a is None else [max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])]
    m, clip, width, stack, path, first, pending, text, out = [1.0, 0, 0, 1, 0, 0], None, 1.0, [], None, 0, False, False, []
    for i, (op, args, *_) in enumerate(ops):
        v = [float(a) for a in args if a[0] not in "/(["]
        if text:
            text = op != "ET"
            if op == "Tj":
                out.append(("text", i, i, clip or list(graphics.PLANE), clip, False, 0.0))
        elif op in graphics.BUILD:
            if path is None:
                path, first = [], i
            x = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2, "h": 0}.get(op)
            path += on(m, [(v[0], v[1]), (v[0] + v[2], v[1]), (v[0], v[1] + v[3]), (v[0] + v[2], v[1] + v[3])] if op == "re" else [(v[2 * k], v[2 * k + 1]) for k in range(x)])
        elif op in ("W", "W*"):
            pending = True
        elif op in graphics.PAINT:
            if path:
                w = width * (math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) or 1) if op[0] in "SsBb" else 0.0
                b = around(path)
                out.append(("path", first, i, [b[0] - w / 2, b[1] - w / 2, b[2] + w / 2, b[3] + w / 2], clip, pending, w))
                clip = meet(clip, b) if pending else clip
            path, pending = None, False
        else:
            path = None
            if op == "BT":
                text = True
            elif op == "q":
                stack.append((m, clip, width))
            elif op == "Q" and stack:
                m, clip, width = stack.pop()
            elif op == "cm":
                m = mul(v, m)
            elif op == "w":
                width = v[0]
            elif op == "sh":
                out.append(("shading", i, i, clip or list(graphics.PLANE), clip, False, 0.0))
            elif op == "Do" and args[0][1:] in OBJECTS:
                kind, box, matrix = OBJECTS[args[0][1:]]
                b = box or [0, 0, 1, 1]
                out.append((kind, i, i, around(on(mul(matrix, m) if matrix else m, [(b[0], b[1]), (b[2], b[1]), (b[0], b[3]), (b[2], b[3])])), clip, False, 0.0))
    return out


def stream(rng):
    n = lambda: str(rng.choice([-3, 0, 0.5, 1, 2, 7.25, 12]))
    many = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4, "cm": 6, "w": 1}
    ops = rng.choices(["q", "Q", "cm", "w", "m", "l", "c", "v", "y", "h", "re", "W", "W*", "S", "f", "B*", "n", "Do Im", "Do Fm", "Do No", "sh /P", "BT", "ET", "Tj"], k=rng.randrange(60))
    return " ".join(f"/{o.split()[1]} Do" if o.startswith("Do") else "/P sh" if o[:2] == "sh" else "(x) Tj" if o == "Tj" else " ".join([*[n() for _ in range(many.get(o, 0))], o]) for o in ops)


def test_items_match_a_plain_loop(spark):
    rng = random.Random(12)
    streams = {f"p{k}": stream(rng) for k in range(120)}
    df = painted.stream_operations(spark.createDataFrame(list(streams.items()), "page string, stream string"))
    objects = spark.createDataFrame([(p, n, *x) for p in streams for n, x in OBJECTS.items()], "page string, name string, kind string, bounds array<double>, matrix array<double>")
    near = lambda b: None if b is None else tuple(round(x, 6) + 0.0 for x in b)
    got = sorted(((r["page"], r["i1"], r["kind"], r["i0"], near(r["box"]), near(r["clip_at"]), r["clips"], round(r["line"], 6)) for r in graphics.page_items(df, objects).collect()), key=repr)
    want = sorted(((p, i1, kind, i0, near(box), near(clip), clips, round(line, 6)) for p, text in streams.items() for kind, i0, i1, box, clip, clips, line in plain(painted.operations(text))), key=repr)
    assert len(got) > 300 and got == want


def test_inline_images_end_with_their_data(spark):
    df = painted.stream_operations(spark.createDataFrame([(1, "2 0 0 3 1 1 cm BI /W 1 ID xx EI Q")], "page int, stream string"))
    none = spark.createDataFrame([], "page int, name string, kind string, bounds array<double>, matrix array<double>")
    assert [(r["kind"], r["i0"], r["i1"], r["box"]) for r in graphics.page_items(df, none).collect()] == [("inline", 1, 3, [1.0, 1.0, 3.0, 4.0])]
    assert graphics.page_items(df.limit(0), none).count() == 0


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(plans.QUERIES[name](spark, SF))
    assert got and got == rows_of_sql(duck, plans.ORACLE_SQL[name])
