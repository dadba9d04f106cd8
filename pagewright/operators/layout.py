"""Geometry of pages: items to lines, segments, columns and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import js_round, running


def items_of(rows: DataFrame) -> DataFrame:
    """Words of lines as positioned items (page, line_no, seq, s, x, w, top, h), when a source has no geometry: 7 points a character across, 6 of them drawn, 14 a line, 10 high."""
    found = rows.select("doc_id", "line_no", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("s"), F.split("text", "[^ ]+", -1).alias("g"))
    ends = running(F.zip_with("s", F.slice("g", 1, F.size("s")), lambda s, g: F.length(g) + F.length(s)), F.lit(0), lambda at, n: at + n)
    words = found.select("doc_id", "line_no", F.posexplode(F.arrays_zip(F.col("s").alias("s"), ends.alias("end"))).alias("seq", "_w"))
    n = F.length("_w.s")
    at = F.col("_w.end") - n
    return words.select(F.col("doc_id").alias("page"), "line_no", "seq", F.col("_w.s").alias("s"), (40 + 7 * at).cast("double").alias("x"), (6 * n).cast("double").alias("w"), (40 + 14 * F.col("line_no")).cast("double").alias("top"), F.lit(10.0).alias("h"))


def anchored(s: Column, i: Column) -> Column:
    """The state after one more item: the open line's number, and top and height of its first item."""
    new = (s["line"] < 0) | (F.abs(s["top"] - i["top"]) > F.greatest(F.lit(2.0), F.least(s["h"], i["h"]) * 0.45))
    return F.struct((s["line"] + new.cast("int")).alias("line"), *[F.when(new, i[c]).otherwise(s[c]).alias(c) for c in ("top", "h")])


def anchor_lines(items: DataFrame) -> DataFrame:
    """(page, seq, top, line): line numbers by the distance to the first item of the line, not to the one before, over the items of a page sorted by top and x.

    A page's items fold in order in the JVM, over an array of the page.
    """
    item = F.struct(F.col("top").cast("double").alias("top"), "x", "seq", F.col("h").cast("double").alias("h"))
    of = items.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("h"))
    told = of.select("page", F.explode(F.arrays_zip(F.col("items"), running(F.col("items"), start, anchored).alias("s"))).alias("z"))
    return told.select("page", F.col("z.items.seq").cast("int").alias("seq"), "z.items.top", "z.s.line")


def segments(items: DataFrame) -> DataFrame:
    """(page, line_no, seg_no, x, x1, n_items): runs of a line, broken where the gap to the farthest right edge so far is over max(6, 0.8 h)."""
    line = Window.partitionBy("page", "line_no").orderBy("x", "seq")
    reach = F.max(F.col("x") + F.col("w")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    broken = items.withColumn("_new", F.coalesce((F.col("x") - reach > F.greatest(F.lit(6.0), F.col("h") * 0.8)).cast("int"), F.lit(1)))
    numbered = broken.withColumn("seg_no", F.sum("_new").over(line) - 1)
    return numbered.groupBy("page", "line_no", "seg_no").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x1"), F.count("*").alias("n_items"))


def second_column(segs: DataFrame, width: float) -> DataFrame:
    """(page, bucket, lines): the 6-point bucket, with its neighbours, where most later segments start, between 28 and 80 % of the width; the smaller of equals. Only pages that reach max(5, 15 % of lines)."""
    later = (F.col("seg_no") > 0) & (F.col("x") > width * 0.28) & (F.col("x") < width * 0.8)
    bucket = F.when(later, js_round(F.col("x") / 6))
    # every line has a segment 0; a page has no more buckets than fit in half its width
    counts = segs.groupBy("page", bucket.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("seg_no") == 0).alias("l"))
    pages = counts.groupBy("page").agg(F.sum("l").alias("n_lines"), F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))).alias("m"))
    near = lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))
    smooth = F.transform(F.map_keys("m"), lambda b: F.struct((-(near(b - 1) + near(b) + near(b + 1))).alias("k"), b.alias("b")))
    best = pages.where(F.size("m") > 0).select("page", "n_lines", F.array_min(smooth).alias("m")).select("page", "n_lines", F.col("m.b").alias("bucket"), (-F.col("m.k")).alias("lines"))
    return best.where(F.col("lines") >= F.greatest(F.lit(5.0), F.col("n_lines") * 0.15)).select("page", "bucket", "lines")


def body_size(items: DataFrame) -> DataFrame:
    """(page, body_size): the most common size rounded to halves, weighted by characters; the smaller of equals."""
    sizes = items.groupBy("page", (js_round(F.col("size") * 2) / 2).alias("q")).agg(F.sum("chars").alias("n"))
    return sizes.groupBy("page").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("q"))).alias("m")).select("page", F.col("m.q").alias("body_size"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): of an even number of values the upper one of the middle. Equal values are counted before they are ranked, no lists."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    ranked = counts.select(by, value, upto.alias("to"), (upto - F.col("n")).alias("from"), F.sum("n").over(Window.partitionBy(by)).alias("all"))
    return ranked.where("from <= floor(all / 2) and floor(all / 2) < to").select(by, F.col(value).alias("median"))


def shifted(boxes: DataFrame, shifts: list[tuple[float, float, float, float, float]], tol: float = 1.0) -> DataFrame:
    """boxes (x0, y0, x1, y1) with dy: shifts (x0, x1, y_bottom, y_top, dy) one after another, each tested where the ones before have moved the box."""
    all_ = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "x1", "lo", "hi", "dy"), s, strict=True)]) for s in shifts])
    middle = (F.col("y0") + F.col("y1")) / 2

    def step(dy: Column, s: Column) -> Column:
        inside = (F.col("x0") >= s["x0"] - tol) & (F.col("x1") <= s["x1"] + tol) & (middle + dy <= s["hi"]) & (middle + dy >= s["lo"])
        return F.when(inside, dy + s["dy"]).otherwise(dy)

    return boxes.withColumn("dy", F.aggregate(all_, F.lit(0.0), step))
