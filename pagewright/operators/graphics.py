"""The graphics state along content streams: where paths, images, forms and text stand, and what clips them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.painted import SHORT, operations
from pagewright.operators.streams import listed

# Operators that build, paint and show, and those whose operands count; the plane, where nothing clips.
BUILD, PAINT, SHOW = ("m", "l", "c", "v", "y", "h", "re"), ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"), ("Tj", "TJ", "'", '"')
WITH_ARGS = ("cm", "w", "m", "l", "c", "v", "y", "re", "Do")
PLANE = (-1e6, -1e6, 1e6, 1e6)
START, UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)
#: How many points a building operator names, as pairs of operands.
PAIRS = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2, "h": 0}


def numbers(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def operands(args: Sequence[str] | None) -> list[float]:
    """The first six operands; what is missing or no number counts 0."""
    out = [0.0] * 6
    for i, a in enumerate((args or ())[:6]):
        try:
            out[i] = float(a)
        except (TypeError, ValueError):
            continue
    return out


def product(m: Sequence[float], n: Sequence[float]) -> tuple[float, ...]:
    """The matrix that first does m, then n."""
    a, b, c, d, e, f = n
    return (m[0] * a + m[1] * c, m[0] * b + m[1] * d, m[2] * a + m[3] * c, m[2] * b + m[3] * d, m[4] * a + m[5] * c + e, m[4] * b + m[5] * d + f)


def seen_by(m: Sequence[float], points: Sequence[tuple[float, float]]) -> tuple[float, ...]:
    """The box of points that matrix m moves."""
    a, b, c, d, e, f = m
    xs, ys = [a * x + c * y + e for x, y in points], [b * x + d * y + f for x, y in points]
    return (min(xs), min(ys), max(xs), max(ys))


def corners(box: Sequence[float]) -> list[tuple[float, float]]:
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x0, y1), (x1, y1)]


def built(op: str, v: Sequence[float]) -> list[tuple[float, float]]:
    """The points that a building operator names."""
    if op == "re":
        return corners((v[0], v[1], v[0] + v[2], v[1] + v[3]))
    return [(v[2 * i], v[2 * i + 1]) for i in range(PAIRS[op])]


class Page:
    """The graphics state of a page; `items` holds what its operators put on the page, but inline images until they end."""

    def __init__(self, page: object) -> None:
        self.page, self.known, self.items, self.inline = page, {}, [], []
        self.ctm, self.clip, self.width, self.stack = START, None, 1.0, []
        self.first, self.box, self.pending, self.text = None, None, False, False

    def put(self, kind: str, i: int, start: int, end: int, box: Sequence[float], i0: int | None = None, ctm: Sequence[float] | None = None, clips: bool = False, painted: bool = True, line: float = 0.0) -> None:
        item = [self.page, i if i0 is None else i0, i, kind, start, end, box, ctm or self.ctm, self.clip, clips, painted, line]
        (self.inline if kind == "inline" else self.items).append(item)

    def paint(self, op: str, i: int, end: int) -> None:
        if self.box is not None:
            a, b, c, d = self.ctm[:4]
            line = self.width * (math.sqrt(abs(a * d - b * c)) or 1.0) if op[0] in "SsBb" else 0.0
            x0, y0, x1, y1 = self.box
            i0, start, ctm = self.first
            self.put("path", i, start, end, (x0 - line / 2, y0 - line / 2, x1 + line / 2, y1 + line / 2), i0, ctm, self.pending, op != "n", line)
            if self.pending:
                c = self.clip or self.box
                self.clip = (max(c[0], x0), max(c[1], y0), min(c[2], x1), min(c[3], y1))
        self.first, self.box, self.pending = None, None, False

    def step(self, i: int, op: str, args: Sequence[str] | None, start: int, end: int) -> None:
        """One more operator."""
        if op == "EI":  # inline images before it end here
            for item in self.inline:
                item[2], item[5] = i, end
            self.items += self.inline
            self.inline = []
        if self.text:
            if op in SHOW:
                self.put("text", i, start, end, self.clip or PLANE)
            self.text = op != "ET"
        elif op in BUILD:
            self.first = self.first or (i, start, self.ctm)
            points = built(op, operands(args))
            if points:
                x0, y0, x1, y1 = seen_by(self.ctm, points)
                b = self.box
                self.box = (x0, y0, x1, y1) if b is None else (min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1))
        elif op in PAINT:
            self.paint(op, i, end)
        elif op in ("W", "W*"):
            self.pending = True
        else:
            self.first, self.box = None, None
            self.text = op == "BT"
            self.other(i, op, args, start, end)

    def other(self, i: int, op: str, args: Sequence[str] | None, start: int, end: int) -> None:
        if op == "q":
            self.stack.append((self.ctm, self.clip, self.width))
        elif op == "Q":
            if self.stack:
                self.ctm, self.clip, self.width = self.stack.pop()
        elif op == "cm":
            self.ctm = product(operands(args), self.ctm)
        elif op == "w":
            self.width = operands(args)[0]
        elif op == "Do":
            kind, bounds, matrix = self.known.get(args[0][1:] if args else None, (None, None, None))
            if kind == "image":
                self.put("image", i, start, end, seen_by(self.ctm, corners(UNIT)))
            elif kind == "form":
                self.put("form", i, start, end, seen_by(product(matrix or START, self.ctm), corners(bounds or UNIT)))
        elif op == "BI":
            self.put("inline", i, start, end, seen_by(self.ctm, corners(UNIT)))
        elif op == "sh":
            self.put("shading", i, start, end, self.clip or PLANE)


ITEM = "i0 int, i1 int, kind string, start int, end int, box array<double>, ctm array<double>, clip_at array<double>, clips boolean, painted boolean, line double"
_BOX = pa.list_(pa.float64())
ITEM_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), _BOX, _BOX, _BOX, pa.bool_(), pa.bool_(), pa.float64()]


_NAMES = [c.split()[0] for c in ITEM.split(", ")]
#: Items of a batch on the way back; items that a task keeps for streams that come again.
OUT, KEPT = 1 << 15, 1 << 18


def followed(ops: Sequence[tuple], objects: str | None) -> list[tuple]:
    """The items of a whole stream's operators, in the order in which they are put on the page; objects as JSON, of one name the first counts."""
    state, floats = Page(None), lambda v: v and [x if x is None else float(x) for x in v]
    for o in json.loads(objects or "[]"):
        if o:
            state.known.setdefault(o.get("name"), (o.get("kind"), floats(o.get("bounds")), floats(o.get("matrix"))))
    for i, (op, args, start, end) in enumerate(ops):
        state.step(i, op, args, start, end)
    return [tuple(x[1:]) for x in state.items + state.inline]


def followed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, pa.RecordBatch]]:
    """Batches of (page, stream, objects) to the items of some of their rows: the batch, which row is the first, how many items each row has, and the items.

    A stream that comes again with the same objects is followed once; what is kept is bounded by its items and by SHORT.
    """
    none = pa.RecordBatch.from_arrays([pa.array([], t) for t in ITEM_TYPES], _NAMES)
    known, pool = {}, none
    for batch in batches:
        first, at, firsts, counts, fresh, n = 0, 0, [], [], [], 0

        def full() -> tuple[pa.RecordBatch, int, np.ndarray, pa.RecordBatch]:
            each = np.array(counts, np.int64)  # noqa: B023
            places = np.repeat(np.array(firsts, np.int64) - np.cumsum(each) + each, each) + np.arange(each.sum())  # noqa: B023
            return batch, first, each, pool.take(pa.array(places))  # noqa: B023

        keys = list(zip(listed(batch.column(1)), listed(batch.column(2)), strict=True))
        for at, key in enumerate(keys):
            place = known.get(key)
            if place is None:
                found = followed(operations(key[0] or ""), key[1])
                place = (pool.num_rows + len(fresh), len(found))
                fresh += found
                if len(key[0] or "") + len(key[1] or "") <= SHORT:
                    known[key] = place
            firsts.append(place[0])
            counts.append(place[1])
            n += place[1]
            if n >= OUT or at == len(keys) - 1:
                if fresh:
                    more = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*fresh, strict=True), ITEM_TYPES, strict=True)], _NAMES)
                    pool = pa.Table.from_batches([pool, more]).combine_chunks().to_batches()[0]
                yield full()
                first, firsts, counts, fresh, n = at + 1, [], [], [], 0
                if pool.num_rows >= KEPT or len(known) >= KEPT // 8:
                    known, pool = {}, none


def with_json(streams: DataFrame) -> DataFrame:
    """streams (page, stream, objects) as followed_batches takes them: two rows have the same objects if the text is the same."""
    return streams.withColumn("_json", F.to_json("objects")).select("page", "stream", "_json")


def listed_items(streams: DataFrame) -> DataFrame:
    """(page, stream, _json, items) of content streams (page, stream, objects): all items of a page in a row, in order, and its objects as JSON."""
    kind = dict(streams.dtypes)["page"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, counts, items in followed_batches(batches):
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            own = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(items.columns, _NAMES))
            yield pa.RecordBatch.from_arrays([*batch.slice(first, len(counts)).columns, own], ["page", "stream", "_json", "items"])

    fields = ", ".join(f"{n}: {c.split()[1]}" for n, c in zip(_NAMES, ITEM.split(", "), strict=True))
    return with_json(streams).mapInArrow(told, f"page {kind}, stream string, _json string, items array<struct<{fields}>>")


def stream_items(streams: DataFrame) -> DataFrame:
    """What page_items tells of content streams (page, stream, objects: an array of name, kind, bounds, matrix), a page in a row.

    A row has all that its items hang on, so operators need not be dealt and sorted: each stream is parsed and followed
    where it lies, and a task holds one page's operators at a time.
    """
    kind = dict(streams.dtypes)["page"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, counts, items in followed_batches(batches):
            pages = batch.column(0).take(pa.array(np.repeat(np.arange(first, first + len(counts)), counts)))
            out = pa.RecordBatch.from_arrays([pages, *items.columns], ["page", *_NAMES])
            yield from (out.slice(k, OUT) for k in range(0, out.num_rows, OUT))

    return with_json(streams).mapInArrow(told, f"page {kind}, {ITEM}")


def page_items(operations: DataFrame, objects: DataFrame) -> DataFrame:
    """(page, i0, i1, kind, start, end, box, ctm, clip_at, clips, painted, line) of content-stream operators (page, i, op, args, start, end).

    kind: path, image, form, inline, shading or text; box and clip_at (null: nothing clips) on the page, boxes of strokes
    with their line; ctm at the item's first operator; clips: the path clips what follows. Texts have no box of their
    own: theirs is the clip. objects (page, name, kind, bounds, matrix) tells the named images and forms; a name that it
    doesn't have draws nothing.

    Saving and restoring nest, so an operator's state hangs on all before it: Spark deals operators and objects by page
    and sorts them, a page's objects first, and each task takes one operator after another, with the saved states as a
    stack; no page is held whole, and nothing is drawn. Restores without a save do nothing. Operands that are no numbers
    count 0.
    """
    kind = dict(operations.dtypes)["page"]
    none = lambda t: F.lit(None).cast(t)
    args = F.when(F.col("op").isin(*WITH_ARGS), F.col("args"))
    ops = operations.select("page", F.col("i").cast("int").alias("i"), "op", args.alias("args"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), none("array<double>").alias("bounds"), none("array<double>").alias("matrix"))
    named = objects.select(F.col("page").cast(kind).alias("page"), F.lit(-1).alias("i"), F.col("kind").alias("op"), F.array("name").alias("args"), none("int").alias("start"), none("int").alias("end"), F.col("bounds").cast("array<double>").alias("bounds"), F.col("matrix").cast("array<double>").alias("matrix"))
    rows = ops.union(named).repartition("page").sortWithinPartitions("page", "i")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def told(of: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * (1 + len(ITEM_TYPES))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [of, *ITEM_TYPES], strict=True)], ["page", *_NAMES])

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for page, i, op, args, start, end, bounds, matrix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or page != state.page:
                    done += state.items + state.inline if state else []
                    state = Page(page)
                if i < 0:
                    state.known.setdefault(args[0], (op, bounds, matrix))
                else:
                    state.step(i, op, args, start, end)
            done += state.items if state else []
            if state:
                state.items = []
            yield told(of)
            done = []
        if state and state.inline:
            done = state.inline
            yield told(of)

    return rows.mapInArrow(folded, f"page {kind}, {ITEM}")
