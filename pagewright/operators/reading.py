"""Reading a page: rows, gutters, leading, bullets and grids from placed lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import js_round
from pagewright.operators.layout import upper_median
from pagewright.operators.streams import sent, values

# Baseline tolerance and widest gap of a row, in sizes; share of the width from which a row spans columns; share of rows that may cross a gutter.
BASELINE, ROW_GAP, SPANS, CROSSING = 0.3, 2.2, 0.7, 0.08


#: Rows of a batch on the way back, and what tells a row.
BATCH = 10_000
ROW = pa.schema([("row", pa.int32()), *[(c, pa.float64()) for c in ("x0", "x1", "y", "size")], ("n_lines", pa.int64())])


def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each line, from the top and then the left, to the first open row that it continues. Lines come sorted; rows above the reach of the page's largest size are closed and go out."""
    page, number, rows, out = object(), 0, [], []
    told = lambda r: (page, *r)
    for batch in batches:
        for p, x, y, width, size, largest in values(batch, ("page", "x", "y", "width", "size", "largest")):
            if p != page:
                out.extend(map(told, rows))
                page, number, rows = p, 0, []
            elif rows and rows[0][3] - y > BASELINE * largest:
                # rows open from the top down: the first is the highest
                out.extend(told(r) for r in rows if r[3] - y > BASELINE * largest)
                rows = [r for r in rows if r[3] - y <= BASELINE * largest]
            for r in rows:
                em = r[4] if r[4] > size else size
                if abs(r[3] - y) <= BASELINE * em and -0.5 <= x - r[2] < ROW_GAP * em:
                    r[1], r[2], r[4] = min(r[1], x), max(r[2], x + width), em
                    r[5] += 1
                    break
            else:
                rows.append([number, x, x + width, y, size, 1])
                number += 1
        if len(out) >= BATCH:
            yield sent(out, batch.schema.field("page").type, ROW)
            out = []
    out.extend(map(told, rows))
    if out:
        yield sent(out, batch.schema.field("page").type, ROW)


def rows(lines: DataFrame) -> DataFrame:
    """(page, row, x0, x1, y, size, n_lines) of placed lines (page, id, x, y, width, size): a line joins the first open row with its baseline whose end it follows closely.

    Which row takes a line hangs on the lines before it, so a page's lines are in one partition, sorted; they stream
    through and only rows that can still take a line are held. Lines with a null place belong to no row.
    """
    kind = dict(lines.dtypes)
    placed = lines.select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "size")]).dropna(subset=["x", "y", "width", "size"])
    order = [F.desc("y"), F.asc("x"), F.asc("id")]
    # the window sorts a page's lines as the fold takes them: one sort does for both
    whole = Window.partitionBy("page").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("largest", F.max("size").over(whole)).sortWithinPartitions("page", *order)
    return placed.mapInArrow(first_fit, f"page {kind['page']}, row int, x0 double, x1 double, y double, size double, n_lines long")


def gutters(found: DataFrame, width: float, min_gap: float) -> DataFrame:
    """(page, a, b): ranges of x of min_gap or more that no row of the page reaches, rows over 70 % of the width left out. The farthest end so far against the next start."""
    upto = Window.partitionBy("page").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    narrow = found.where(F.col("x1") - F.col("x0") < SPANS * width).select("page", "x0", F.max("x1").over(upto).alias("a"))
    return narrow.where(F.col("x0") - F.col("a") >= min_gap).select("page", "a", F.col("x0").alias("b"))


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where the lists of structs begin and end, and the values of each field of all of them."""
    return column.offsets.to_numpy(), column.values.flatten()


def strips_of(x0: np.ndarray, x1: np.ndarray, min_gap: float) -> list[tuple[float, float, int, int, int]]:
    """The strips of a page's rows, as column_gutters tells them. Coverage at half points is a running sum over the starts and ends of rows."""
    both = ~(np.isnan(x0) | np.isnan(x1))
    if not both.any():
        return []
    o, e = np.floor(np.nanmin(x0)), np.ceil(np.nanmax(x1))
    starts, stops = np.floor((x0[both] - o) * 2), np.ceil((x1[both] - o) * 2)
    at, of = np.unique(np.concatenate([starts, stops, [(e - o) * 2]]), return_inverse=True)
    cov = np.cumsum(np.bincount(of, np.repeat([1.0, -1.0, 0.0], [len(starts), len(stops), 1])))[:-1]
    thin = np.flatnonzero(cov <= np.floor(len(x0) * CROSSING))
    out = []
    for strip in np.split(thin, np.flatnonzero(np.diff(thin) > 1) + 1) if len(thin) else []:
        emptiest = strip[cov[strip] == cov[strip].min()]
        a, b = o + at[emptiest[0]] / 2, o + at[emptiest[-1] + 1] / 2
        if b - a >= min_gap:
            sides = [int(np.count_nonzero(c)) for c in (x1 <= a + 0.5, x0 >= b - 0.5, (x0 < a - 0.5) & (x1 > b + 0.5))]
            out += [(a, b, *sides)] if min(sides[:2]) >= 2 else []
    return out


def column_gutters(found: DataFrame, min_gap: float) -> DataFrame:
    """(page, a, b, n_left, n_right, n_cross): strips of min_gap or more that 8 % of the rows at most cross, cut to their emptiest part, with two rows or more on both sides.

    A page's rows are in one row and told in one pass. Pages of under four rows have none.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (x0, x1) = lists_of(batch.column("rows"))
            x0, x1 = (c.to_numpy(zero_copy_only=False) for c in (x0, x1))
            out = [(i, *strip) for i, (k, n) in enumerate(zip(at[:-1], at[1:], strict=True)) for strip in strips_of(x0[k:n], x1[k:n], min_gap)]
            if out:
                i, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(i, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, [pa.float64()] * 2 + [pa.int64()] * 3, strict=True)]], ["page", "a", "b", "n_left", "n_right", "n_cross"])

    placed = found.where("page is not null").groupBy("page").agg(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))).alias("rows"))
    kind = placed.schema["page"].dataType.simpleString()
    return placed.where(F.size("rows") >= 4).mapInArrow(told, f"page {kind}, a double, b double, n_left long, n_right long, n_cross long")


def leading(found: DataFrame) -> DataFrame:
    """(page, lead): the upper median of the baseline steps within half a point of the commonest step; of equally common ones the smaller. Steps between 0.8 and 3 sizes, rows of one size."""
    down = Window.partitionBy("page").orderBy(F.desc("y"), "x0")
    size, step = F.lag("size").over(down), F.lag("y").over(down) - F.col("y")
    steps = found.select("page", "size", size.alias("_s"), step.alias("d")).where((F.abs(F.col("_s") - F.col("size")) < 0.1 * F.col("_s")) & (F.col("d") > 0.8 * F.col("_s")) & (F.col("d") < 3 * F.col("_s")))
    steps = steps.select("page", "d", (js_round(F.col("d") * 2) / 2).alias("q"))
    mode = steps.groupBy("page", "q").agg(F.count("*").alias("n")).groupBy("page").agg(F.min(F.struct((-F.col("n")).alias("k"), "q")).alias("m")).select("page", F.col("m.q").alias("mode"))
    near = steps.join(mode, "page").where(F.abs(F.col("d") - F.col("mode")) <= 0.5)
    return upper_median(near, "page", "d").withColumnRenamed("median", "lead")


def targets_of(x: np.ndarray, y: np.ndarray, size: np.ndarray, bullet: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of bullets and of their targets among a page's lines in the order of their ids; name: the number of each id."""
    bullets, texts = np.flatnonzero((bullet == 1) & ~np.isnan(y)), np.flatnonzero(bullet == 0)
    if not len(bullets) or not len(texts) or np.isnan(size).all():
        return bullets[:0], bullets[:0]
    texts = texts[np.argsort(y[texts], kind="stable")]
    reach = 1.8 * np.nanmax(size) * (1 + 1e-9) + 1e-9
    first, last = np.searchsorted(y[texts], y[bullets] - reach), np.searchsorted(y[texts], y[bullets] + reach, "right")
    many = last - first
    b, t = np.repeat(bullets, many), texts[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
    gap = x[t] - x[b]
    met = (gap > 0.25 * size[t]) & (gap < 3 * np.fmax(size[t], size[b]))
    b, t, gap = b[met], t[met], gap[met]
    dy = y[t] - y[b]
    owns = (gap < 3 * size[t]) & (np.abs(dy) <= 0.5 * size[t])
    low, high = np.full(len(x), len(x)), np.full(len(x), -1)
    np.minimum.at(low, name[t[owns]], name[b[owns]])
    np.maximum.at(high, name[t[owns]], name[b[owns]])
    others = (high[name[t]] >= 0) & ((low[name[t]] != name[b]) | (high[name[t]] != name[b]))
    near = (np.abs(dy) <= 1.8 * size[t]) & ((np.abs(dy) <= 0.12 * size[t]) | ~others)
    b, t, dy = b[near], t[near], dy[near]
    order = np.lexsort((t, np.abs(dy) * np.where(dy > 0, 1.5, 1.0), name[b]))
    best = order[np.diff(name[b[order]], prepend=-1) > 0]
    return b[best], t[best]


def bullet_pairs(lines: DataFrame) -> DataFrame:
    """bullet_targets() with dy, how far the target's baseline is above the bullet's, and the target's size. A page's lines are in one row, where a bullet sees those near it alone."""
    number = {k: F.col(k).cast("double").alias(k) for k in ("x", "y", "size")}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (ids, x, y, size, bullet) = lists_of(batch.column("lines"))
            x, y, size, bullet = (c.to_numpy(zero_copy_only=False) for c in (x, y, size, bullet))
            names = ids.to_numpy(zero_copy_only=False)
            pages, bs, ts = [], [], []
            for i, (k, n) in enumerate(zip(at[:-1], at[1:], strict=True)):
                b, t = targets_of(x[k:n], y[k:n], size[k:n], bullet[k:n], np.cumsum(np.append(False, names[k + 1 : n] != names[k : n - 1])))
                pages.append(np.full(len(b), i))
                bs.append(b + k)
                ts.append(t + k)
            i, b, t = (np.concatenate(c or [np.zeros(0)]).astype(np.int64) for c in (pages, bs, ts))
            yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(i)), ids.take(pa.array(b)), ids.take(pa.array(t)), pa.array(y[t] - y[b]), pa.array(size[t])], ["page", "id", "target", "dy", "size"])

    line = F.struct("id", *number.values(), F.coalesce(F.col("bullet").cast("int"), F.lit(-1)).alias("bullet"))
    placed = lines.where("page is not null").groupBy("page").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    page, name = (lines.schema[c].dataType.simpleString() for c in ("page", "id"))
    return placed.mapInArrow(told, f"page {page}, id {name}, target {name}, dy double, size double")


def bullet_targets(lines: DataFrame) -> DataFrame:
    """(page, id, target) for each bullet of lines (page, id, x, y, size, bullet): the line starting just right of it with the nearest baseline, a line above costing half as much again.

    A line off the bullet's baseline that another bullet owns is no target; of equals the first by id. Bullets without a target are left out.
    """
    return bullet_pairs(lines).select("page", "id", "target")


def grid_runs(segs: DataFrame, tol: float = 5.0) -> DataFrame:
    """(page, line_no, run): lines that share two segment starts or more with the line before, numbered from 2 within a run; a run that reaches 3 is a table.

    A line's starts are in one row, sorted, beside those of the line before: no joins.
    """

    @F.pandas_udf("long")
    def shared(starts: pd.Series, before: pd.Series) -> pd.Series:
        def one(x: np.ndarray, p: np.ndarray) -> int:
            if not len(p):
                return 0
            at = np.searchsorted(p, x)
            return int(np.count_nonzero((np.abs(x - p[np.maximum(at - 1, 0)]) < tol) | (np.abs(x - p[np.minimum(at, len(p) - 1)]) < tol)))

        return pd.Series([one(x, p) for x, p in zip(starts, before, strict=True)], dtype="int64")

    order = Window.partitionBy("page").orderBy("line_no")
    lines = segs.where("page is not null and line_no is not null").groupBy("page", "line_no").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col("x").cast("double"))).alias("xs"))
    placed = lines.select("page", "line_no", F.row_number().over(order).alias("at"), F.lag("n").over(order).alias("many"), "xs", F.lag("xs").over(order).alias("before"))
    found = placed.where("many >= 2 and size(xs) >= 2").select("page", "line_no", "at", shared("xs", "before").alias("n")).where("n >= 2")
    island = found.withColumn("_i", F.col("at") - F.row_number().over(order))
    run = F.row_number().over(Window.partitionBy("page", "_i").orderBy("line_no")) + 1
    return island.select("page", "line_no", run.alias("run"))
