"""Logical lines of a page of one or two columns: the sidebar found, tables told from it, and rows of one baseline put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import clean, running

# Rows of a page and of each side that a sidebar needs, where its gutter may stand, how near baselines and sizes are, in sizes; shares of a narrow side that make a table of it, and the gap of a column's first line.
ROWS, SIDE, FROM, TO, BASE, KIN = 8, 4, 0.18, 0.82, 0.3, 0.15
DATED, DATED_LEAST, BESIDE, FIRST_GAP = 0.6, 2, 0.8, 99.0


def sidebars(rows: DataFrame, gutters: DataFrame, width: float) -> DataFrame:
    """(page, a, b): the gutter of a page that parts a sidebar from the text, of several the one with most rows beside it, then the leftmost; rows (page, row, x0, x1, y, size, dated), gutters (page, a, b, n_left, n_right).

    A gutter whose narrow side stands on the baselines of the other side and holds dates mostly is that of a table
    ("Role .... 2019 - 2021"): such pages have none. Rows of both sides meet in bands of the height.
    """
    enough = rows.groupBy("page").agg(F.count("*").alias("_n"), F.max("size").alias("_w")).where(F.col("_n") >= ROWS)
    mid = (F.col("a") + F.col("b")) / 2
    fit = gutters.where((F.col("n_left") >= SIDE) & (F.col("n_right") >= SIDE) & (mid > FROM * width) & (mid < TO * width)).join(enough, "page")
    best = fit.groupBy("page", "_w").agg(F.min(F.struct((-(F.col("n_left") + F.col("n_right"))).alias("k"), "a", "b")).alias("g")).select("page", "_w", "g.a", "g.b")
    side = F.when(F.col("x1") <= F.col("a") + 0.5, 0).when(F.col("x0") >= F.col("b") - 0.5, 1)
    sided = rows.join(best, "page").withColumn("side", side).where("side is not null")
    wide = sided.groupBy("page").agg(*[F.max(F.when(F.col("side") == s, F.col("x1") - F.col("x0"))).alias(c) for s, c in ((0, "wl"), (1, "wr"))])
    narrow = F.when(F.coalesce("wl", F.lit(0.0)) >= F.coalesce("wr", F.lit(0.0)), 1).otherwise(0)
    sided = sided.join(wide.select("page", narrow.alias("narrow")), "page")
    band = F.floor(F.col("y") / F.col("_w"))
    own = sided.where("side = narrow").select("page", "row", "y", "size", "dated", F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    other = sided.where("side <> narrow").select("page", F.col("y").alias("oy"), F.col("size").alias("os"), band.alias("_b"))
    beside = own.join(other, ["page", "_b"]).where(F.abs(F.col("oy") - F.col("y")) <= BASE * F.greatest("os", "size")).groupBy("page", "row").agg(F.first("dated").alias("dated"))
    counts = beside.groupBy("page").agg(F.count("*").alias("beside"), F.count_if("dated").alias("paired"))
    total = sided.where("side = narrow").groupBy("page").agg(F.count("*").alias("all"))
    table = (F.col("paired") >= DATED * F.col("all")) | (F.col("paired") >= DATED_LEAST) & (F.col("beside") >= BESIDE * F.col("all"))
    tables = total.join(counts, "page").where(table).select("page")
    return best.select("page", "a", "b").join(tables, "page", "left_anti")


def in_columns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with col: 0 for what crosses the gutter or stands above both sides, 1 for the side with the wider rows, 2 for the other, 3 for the rest; 0 for all rows of a page without a sidebar (found: sidebars)."""
    of = Window.partitionBy("page")
    met = rows.join(found, "page", "left")
    left, right = F.col("x1") <= F.col("a") + 0.5, F.col("x0") >= F.col("b") - 0.5
    cross = (F.col("x0") < F.col("a") - 0.5) & (F.col("x1") > F.col("b") + 0.5)
    side = F.when(cross, -1).when(left, 0).when(right, 1).otherwise(2)
    met = met.withColumn("_s", F.when(F.col("a").isNotNull(), side))
    wide = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("x1") - F.col("x0"))).over(of), F.lit(0.0))
    high = F.max(F.when(F.col("_s").isin(0, 1), F.col("y"))).over(of)
    met = met.withColumns({"_l": wide(0), "_r": wide(1), "_h": F.coalesce(high, F.lit(-1e9))})
    first = F.when(F.col("_l") >= F.col("_r"), 0).otherwise(1)
    col = F.when(F.col("_s").isNull() | (F.col("_s") == -1), 0).when(F.col("_s") == first, 1).when(F.col("_s").isin(0, 1), 2).when(F.col("y") > F.col("_h"), 0).otherwise(3)
    return met.withColumn("col", col).select(*rows.columns, "col")


def same_line(s: Column, r: Column) -> Column:
    """The state after one more row down a column: the line's number, height and size; rows on its baseline join it."""
    joins = (s["line"] >= 0) & (F.abs(s["y"] - r["y"]) <= BASE * F.greatest(s["size"], r["size"]))
    return F.struct(F.when(joins, s["line"]).otherwise(s["line"] + 1).alias("line"), F.when(joins, s["y"]).otherwise(r["y"]).alias("y"), F.when(joins, F.greatest(s["size"], r["size"])).otherwise(r["size"]).alias("size"))


def same_part(s: Column, p: Column) -> Column:
    """The state after one more row along a line: the part's number, end, size and height; a row of its size that starts before it ends is part of it."""
    most = F.greatest(s["size"], p["size"])
    joins = (s["part"] >= 0) & (F.abs(s["size"] - p["size"]) <= KIN * most) & (F.abs(s["y"] - p["y"]) <= KIN * most) & (p["x0"] < s["x1"] - 0.5)
    return F.struct(F.when(joins, s["part"]).otherwise(s["part"] + 1).alias("part"), F.when(joins, F.greatest(s["x1"], p["x1"])).otherwise(p["x1"]).alias("x1"), *[F.when(joins, s[c]).otherwise(p[c]).alias(c) for c in ("size", "y")])


def logical_lines(rows: DataFrame) -> DataFrame:
    """(page, col, line, text, parts, x, y, size, bold, caps, gap) of rows (page, col, row, x0, x1, y, size, bold, pieces: their lines as x and text): the lines a reader reads, down each column.

    Rows on one baseline of a column are a line; its parts, from the left, are told apart by their gaps, and those that run
    into each other are put together piece by piece. gap: the step from the line above. Both folds go over a column's or a
    line's rows in the JVM.
    """
    row = F.struct((-F.col("y")).alias("k"), "x0", "row", "x1", "y", "size", F.coalesce("bold", F.lit(False)).alias("bold"), "pieces")
    of = rows.groupBy("page", "col").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.lit(0.0).alias("size"))
    told = of.select("page", "col", F.explode(F.arrays_zip(F.col("rows"), running(F.col("rows"), start, same_line).alias("s"))).alias("z"))
    part = F.struct("z.rows.x0", "z.rows.row", "z.rows.x1", "z.rows.y", "z.rows.size", "z.rows.bold", "z.rows.pieces")
    lines = told.groupBy("page", "col", F.col("z.s.line").alias("line")).agg(F.array_sort(F.collect_list(part)).alias("p"), F.first("z.s.y").alias("y"), F.max("z.rows.size").alias("size"), F.min("z.rows.x0").alias("x"), F.bool_and("z.rows.bold").alias("bold"))
    zero = F.lit(0.0)
    start = F.struct(F.lit(-1).alias("part"), zero.alias("x1"), zero.alias("size"), zero.alias("y"))
    split = lines.withColumn("s", running(F.col("p"), start, same_part))
    n = F.element_at("s", -1)["part"]
    own = lambda k: F.flatten(F.transform(F.filter(F.arrays_zip(F.col("p"), F.col("s")), lambda z: z["s"]["part"] == k), lambda z: z["p"]["pieces"]))
    said = F.transform(F.sequence(F.lit(0), n), lambda k: clean(F.array_join(F.transform(F.array_sort(own(k)), lambda x: x["text"]), " ")))
    out = split.withColumn("parts", said).withColumn("text", clean(F.regexp_replace(F.array_join("parts", "   "), r"[\x{0}-\x{8}\x{E}-\x{1F}\x{FFFD}]+", " ")))
    down = Window.partitionBy("page", "col").orderBy("line")
    gap = F.coalesce(F.lag("y").over(down) - F.col("y"), F.lit(FIRST_GAP))
    caps = F.col("text").rlike("[A-Z]{3}") & ~F.col("text").rlike("[a-z]")
    return out.withColumn("gap", gap).select("page", "col", "line", "text", "parts", "x", "y", "size", "bold", caps.alias("caps"), "gap")
