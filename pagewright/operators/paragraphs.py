"""Reading order of a page, and the paragraphs and list items that its rows make."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagewright.operators.reading import column_gutters
from pagewright.operators.streams import listed

# Fixed values, in leadings: steps within a paragraph and an item, to an item's neighbours; in sizes: what is a new size, the height of a cut across the page, the width of a space.
STEP, CLOSE, ITEM_STEP, NEIGHBOUR, NEXT_ITEM, FAR_NEIGHBOUR = 1.25, 0.5, 1.3, 2.6, 2.2, 1.4
OTHER_SIZE, CUT, SPACE, SAME_BASE, LIKE_SIZE = 0.1, 1.2, 0.28, 0.4, 0.15
#: Phrases that end like this go on; points within which two edges are one, and within which an item's lines start.
OPEN_END = r"(?i)(,|;|-|–|&|(?<![0-9a-z_])and|(?<![0-9a-z_])or|(?<![0-9a-z_])of|(?<![0-9a-z_])the|(?<![0-9a-z_])with|(?<![0-9a-z_])for|(?<![0-9a-z_])to|(?<![0-9a-z_])in)\s*$"
EDGE, ITEM_EDGE = 1.5, 2.5
#: Code points that tell an open end: its longest word, one before it and one more.
OPEN_LENGTH = 6


class Row(NamedTuple):
    """What tells where a row's paragraph ends; item_end: the place of the last row of the item that it begins; far: the right edge of the column's rows of its size."""

    i: int
    x0: float
    x1: float
    text_x: float
    label_x: float
    size: float
    fits_to: float
    above_x1: float
    bold: bool | None
    last_bold: bool | None
    capital: bool
    above_open: bool
    hard: bool
    level: bool
    item_end: float
    far: float


def reading_order(rows: DataFrame, min_gap: float, depth: int = 2) -> DataFrame:
    """rows (page, row, x0, x1, y, size) with region, the place they are cut into, and rank, their order on the page.

    A page is cut across at white gaps of 1.2 sizes, each band into columns at its gutters, and each column again, `depth`
    times; what isn't cut stays whole. Regions are read from the top and from the left, rows in them down.
    """
    out = rows.withColumn("region", F.array().cast("array<int>"))
    for _ in range(depth):
        down = Window.partitionBy("page", "region").orderBy(F.desc(F.col("y") + 0.8 * F.col("size")), "x0", "row")
        low = F.min(F.col("y") - 0.2 * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("_cut", F.coalesce((low - (F.col("y") + 0.8 * F.col("size")) >= CUT * F.col("size")).cast("int"), F.lit(0)))
        out = out.withColumn("region", F.array_append("region", F.sum("_cut").over(down).cast("int"))).drop("_cut")
        strips = column_gutters(out.select(F.struct("page", "region").alias("page"), "x0", "x1"), min_gap)
        mids = strips.groupBy("page").agg(F.collect_list((F.col("a") + F.col("b")) / 2).alias("mids")).select("page.page", "page.region", "mids")  # a strip is min_gap wide at least: few a page
        left = F.size(F.filter("mids", lambda m: m <= F.col("x0") + 0.5))
        out = out.join(mids, ["page", "region"], "left").withColumn("region", F.array_append("region", F.greatest(F.lit(0), F.coalesce(left, F.lit(0))))).drop("mids")
    order = Window.partitionBy("page").orderBy("region", F.desc("y"), "x0", "row")
    return out.withColumn("rank", F.row_number().over(order).cast("long") - 1)


def list_items(rows: DataFrame) -> DataFrame:
    """(page, col, s, e): the list items of columns, by the places of their first and last rows; rows (page, col, i, x0, text_x, y, size, mark or null, lead).

    An item goes on while rows follow within 1.3 leadings, of its size, from where its text starts. It counts if it wraps or
    the item before or after it has the same mark close by.
    """
    down = Window.partitionBy("page", "col").orderBy("i")
    marked = rows.withColumn("run", F.count("mark").over(down)).where("run > 0")
    inside = Window.partitionBy("page", "col", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda c: F.first(c).over(inside)
    step = F.lag("y").over(Window.partitionBy("page", "col", "run").orderBy("i")) - F.col("y")
    goes = F.col("mark").isNotNull() | (step <= ITEM_STEP * F.col("lead")) & (F.abs(F.col("x0") - head("text_x")) < ITEM_EDGE) & (F.abs(F.col("size") - head("size")) < OTHER_SIZE * head("size"))
    marked = marked.withColumn("goes", goes).withColumn("in_item", F.min("goes").over(inside))
    runs = marked.groupBy("page", "col", "run").agg(
        F.min("i").alias("s"), F.max(F.when(F.col("in_item"), F.col("i"))).alias("e"), F.max("mark").alias("mark"), F.max("lead").alias("lead"), F.max(F.when(F.col("mark").isNotNull(), F.col("y"))).alias("y"),
        F.min(F.when(F.col("in_item"), F.col("y"))).alias("y_end"), F.max(F.col("y") + NEIGHBOUR * F.col("lead") * F.col("i")).alias("reach"),
    )
    along = Window.partitionBy("page", "col").orderBy("run")
    before, after = (lambda c: F.lag(c).over(along)), (lambda c: F.lead(c).over(along))
    gap, rows_between = before("y") - F.col("y"), F.col("s") - before("s")
    close = (gap <= F.greatest(NEIGHBOUR * F.col("lead"), (rows_between + 1) * FAR_NEIGHBOUR * F.col("lead"))) & (before("reach") <= F.col("y") + NEIGHBOUR * F.col("lead") * F.col("s") + 1e-9)
    above = F.coalesce((before("mark") == F.col("mark")) & close, F.lit(False))
    below = F.coalesce((after("s") == F.col("e") + 1) & (after("mark") == F.col("mark")) & (F.col("y_end") - after("y") <= NEXT_ITEM * F.col("lead")), F.lit(False))
    return runs.withColumn("_ok", (F.col("e") > F.col("s")) | above | below).where("_ok").select("page", "col", "s", "e")


def goes_on(a: Row, q: Row) -> bool:
    """Whether row q, not broken off by itself, goes on in a paragraph that row a began. What is unknown (no number) doesn't."""
    same_edge = abs(q.x0 - a.x0) < EDGE or abs(q.x0 - a.text_x) < EDGE or a.x0 < q.x0 < a.label_x + EDGE
    fits = q.fits_to == q.fits_to and not q.fits_to >= a.far - 0.5
    own_entry = q.capital and not q.above_open and not q.above_x1 >= a.far - 2 * a.size
    return same_edge and not fits and not own_entry and q.bold is not None and q.bold == a.last_bold and abs(q.size - a.size) < OTHER_SIZE * a.size


def spans(rows: list[Row]) -> Iterator[tuple[int, int, str]]:
    """(first, last, kind) of a column's rows, in order."""
    widest: dict[float, float] = {}
    for r in rows:
        widest[r.size] = max(widest.get(r.size, r.x1), r.x1) if r.x1 == r.x1 else widest.get(r.size, r.x1)
    far = {size: max((x for s, x in widest.items() if abs(s - size) < LIKE_SIZE * size and x == x), default=float("nan")) for size in widest}
    rows = [r._replace(far=far[r.size]) for r in rows]
    open_, reach, begun, low, high = [], {}, [], [], []
    for k, r in enumerate(rows):
        top = r.hard or r.level or not goes_on(rows[k - 1], r)
        open_ = [a for a in open_ if not r.hard and goes_on(rows[a], r)] + [k] * top
        reach.update(dict.fromkeys(open_, r.i))
        begun.append(k if top else begun[-1])
        low.append(low[-1] if r.level else r.i)
    for k in reversed(range(len(rows))):
        high.append(high[-1] if high and rows[k + 1].level else rows[k].i)
    lows, highs = {r.i: x for r, x in zip(rows, low, strict=True)}, {r.i: x for r, x in zip(rows, reversed(high), strict=True)}
    start = end = -1
    for r, k in zip(rows, begun, strict=True):
        if r.item_end == r.item_end and r.item_end is not None:
            start, end = r.i, int(r.item_end)
        if r.i <= end:
            yield lows[start], highs[end], "item"
        else:
            yield lows[rows[k].i], highs[max(r.i, reach[k])], "para"


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds first, last and kind to rows sorted by column and place; only a column is held. `new` marks a column's first row."""

    def ended(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        read = {c: listed(table.column(c).combine_chunks()) for c in (*Row._fields, "new") if c != "far"}
        rows = [Row(*r, float("nan")) for r in zip(*(read[c] for c in Row._fields[:-1]), strict=True)]
        starts = [k for k, new in enumerate(read["new"]) if new]
        out = [x for first, last in zip(starts, [*starts[1:], len(rows)], strict=True) for x in spans(rows[first:last])]
        first, last, kind = zip(*out, strict=True)
        added = table.append_column("first", pa.array(first, pa.int32())).append_column("last", pa.array(last, pa.int32())).append_column("kind", pa.array(kind, pa.string()))
        yield from added.to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("new").to_numpy(zero_copy_only=False))
        if len(starts) and (held or starts[-1]):
            cut = int(starts[-1])
            yield from ended([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held and sum(b.num_rows for b in held):
        yield from ended(held)


def paragraphs(rows: DataFrame) -> DataFrame:
    """rows of columns (page, col, row, x0, x1, text_x, label_x, y, size, text, bold, last_bold, mark, lead) with i, their place in the column, and first, last, kind: the paragraph or item of each.

    bold: all of the row; last_bold: its last line; text_x: where the text after a mark starts; mark: what marks an item, or
    null; label_x: where the text after a bold label starts, or null; lead: the column's leading.

    A row begins a paragraph, told from both its sides, if it has a mark or label or a step that isn't the leading, or if
    its weight, size or edge isn't that of the row above, or that row had room for its first word, or it is a list entry.
    Rows between two such breaks are an island. A paragraph ends where the same rules, held against the island's first row,
    say so: a column's rows stream through a task in order, with the islands' first rows that are still open. Items come
    first. Rows on one baseline with the first or last row belong to it.
    """
    down = Window.partitionBy("page", "col").orderBy(F.desc("y"), "x0", "row")
    at = rows.where("page is not null and col is not null").withColumn("i", F.row_number().over(down) - 1).where((F.col("size") > 0) & ~F.isnan("size"))
    col = Window.partitionBy("page", "col").orderBy("i")
    above = lambda c: F.lag(c).over(col)
    bare = F.btrim("text")
    # a phrase's end is looked for at the end alone; a rare line terminator there is left to the expression
    tail = F.when(F.right(bare, F.lit(1)).rlike(r"[\x{85}\x{2028}\x{2029}]"), bare).otherwise(F.right(F.rtrim(bare, F.lit(" \t\n\x0b\x0c\r")), F.lit(OPEN_LENGTH)))
    word = F.regexp_extract(bare, r"^\S+", 0)
    step = above("y") - F.col("y")
    fits_to = F.when(word != "", above("x1") + SPACE * F.col("size") + (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length(bare)) * F.length(word))
    ends = list_items(at).select("page", "col", F.col("s").alias("i"), F.col("e").cast("double").alias("item_end"))
    at = at.join(ends, ["page", "col", "i"], "left").withColumn("open", tail.rlike(OPEN_END)).select("*", above("i").isNull().alias("new"), above("x1").alias("above_x1"), F.coalesce(above("open"), F.lit(False)).alias("above_open"),
        F.coalesce(F.col("mark").isNotNull() | F.col("label_x").isNotNull() | (step > STEP * F.col("lead")) | (step < CLOSE * F.col("lead")), F.lit(True)).alias("hard"), F.coalesce(bare.rlike("^[A-Z]"), F.lit(False)).alias("capital"),
        fits_to.alias("fits_to"), F.coalesce(F.abs(step) < SAME_BASE * F.greatest("size", above("size")), F.lit(False)).alias("level"))
    numbers = ["x0", "x1", "text_x", "label_x", "size", "fits_to", "above_x1"]
    kept = F.struct(*rows.columns).alias("row")
    told_by = at.select(kept, "page", "col", "i", *[F.col(c).cast("double").alias(c) for c in numbers], "bold", "last_bold", "capital", "above_open", "hard", "level", "item_end", "new").sortWithinPartitions("page", "col", "i")
    schema = StructType([*told_by.schema.fields, *(StructField(c, k) for c, k in (("first", IntegerType()), ("last", IntegerType()), ("kind", StringType())))])
    return told_by.mapInArrow(told, schema).select("row.*", "i", "first", "last", "kind")
