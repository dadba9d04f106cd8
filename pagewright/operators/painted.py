"""Painted runs and lines: what draws a line, hidden text, bullets, alignment, fonts by place, and content streams as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import dealt_by

# Marks of lists, fonts of symbols, and the reasons for which a page isn't edited.
BULLET_MARK = r"^[\x{2022}\x{2023}\x{2043}\x{2219}\x{00B7}\x{25CF}\x{25CB}\x{25AA}\x{25AB}\x{25A0}\x{25A1}\x{25E6}\x{25BA}\x{25B8}\x{25B6}\x{27A2}\x{2794}\x{2713}\x{2714}\x{2666}\x{2756}\x{2605}\x{2013}\x{2014}*>\x{E000}-\x{F8FF}-]$"
SYMBOL_FONT = "(?i)symbol|dingbat|wingding|webding"
INVISIBLE = (3, 7)


def is_bullet_run(text: Column, font: Column) -> Column:
    """One character that marks a list, or any one of a symbol font."""
    t = F.btrim(text)
    return (F.length(t) == 1) & (t.rlike(BULLET_MARK) | F.coalesce(font, F.lit("")).rlike(SYMBOL_FONT))


#: Points of a band in which lines and images meet.
BAND = 50


def drawn_by(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(page, id, run, seq, mode) of lines (page, id, x, y, width, size) and runs (page, run, seq, x, y, mode): the upright runs that start on a line's baseline and within it.

    Lines meet runs by page and band of the page's largest size, so a line sees the runs near it, not its page.
    """
    sized = lines.withColumn("_band", F.max("size").over(Window.partitionBy("page")))
    largest = sized.select("page", "_band").distinct()
    band = lambda y: F.floor(y / F.col("_band"))
    near = sized.withColumn("_b", F.explode(F.array(band(F.col("y")) - 1, band(F.col("y")), band(F.col("y")) + 1))).drop("_band")
    placed = runs.join(largest, "page").select("page", "run", "seq", F.col("x").alias("rx"), F.col("y").alias("ry"), "mode", band(F.col("y")).alias("_b"))
    on = (F.abs(F.col("ry") - F.col("y")) <= 0.3 * F.col("size")) & (F.col("rx") >= F.col("x") - 0.3 * F.col("size")) & (F.col("rx") <= F.col("x") + F.col("width") - 0.05 * F.col("size"))
    return near.join(placed, ["page", "_b"]).where(on).select("page", "id", "run", "seq", "mode")


def hidden_lines(lines: DataFrame, runs: DataFrame, images: DataFrame) -> DataFrame:
    """(page, id, reason) of the lines that don't show: all their runs are invisible, or an opaque image (page, seq, x0, y0, x1, y1) painted after the last of them covers the line. Lines meet the images that reach into their band of the page."""
    told = drawn_by(lines, runs).groupBy("page", "id").agg(F.bool_and(F.col("mode").isin(*INVISIBLE)).alias("invisible"), F.max("seq").alias("last"))
    band = lambda y: F.floor(y / BAND)
    drawn = lines.join(told, ["page", "id"])
    i = images.where("y1 >= y0").select("page", F.col("seq").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(band(F.col("y0") - 1), band(F.col("y1") + 1))).alias("_b"))
    under = (F.col("_s") > F.col("last")) & (F.col("_x0") <= F.col("x") + 1) & (F.col("_x1") >= F.col("x") + F.col("width") - 1)
    under = under & (F.col("_y0") <= F.col("y") - 0.22 * F.col("size") + 1) & (F.col("_y1") >= F.col("y") + 0.78 * F.col("size") - 1)
    covered = drawn.withColumn("_b", band(F.col("y"))).join(i, ["page", "_b"]).where(under).select("page", "id").distinct().withColumn("_c", F.lit(True))
    out = drawn.join(covered, ["page", "id"], "left").select("page", "id", F.when(F.col("invisible"), "invisible").when(F.col("_c"), "covered").alias("reason"))
    return out.where("reason is not null")


def page_refusals(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, code) of pages (page, images, paths) that can't be edited: their lines (page, id, hidden) are all but hidden, or there are none."""
    told = lines.groupBy("page").agg(F.count("*").alias("n"), F.count_if("hidden").alias("h"))
    code = F.when(F.col("n") > 0, F.when(F.col("h") >= 0.8 * F.col("n"), "ocr")).when((F.col("images") > 0) & (F.col("paths") < 40), "scanned").when(F.col("paths") >= 40, "outlines").otherwise("empty")
    return pages.join(told, "page", "left").select("page", code.alias("code")).where("code is not null")


def stray_bullets(pairs: DataFrame) -> DataFrame:
    """(page, id, target, dy) of bullets and their targets (page, id, target, dy, size) whose baselines differ by more than 0.12 of the target's size, to a thousandth."""
    return pairs.where(F.abs("dy") > 0.12 * F.col("size")).select("page", "id", "target", (F.floor(F.col("dy") * 1000 + 0.5) / 1000).alias("dy"))


def fonts_by_place(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page, key, font) of two readings of a page's fonts in order (page, at, key) and (page, at, font): by their places. A page whose readings differ in length, or where a key meets two fonts, has none.

    Both readings are dealt by page once; places and pages are windows, no joins.
    """
    none = lambda rows, c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
    both = ours.select("page", "at", "key", none(theirs, "font"), F.lit(True).alias("own")).union(theirs.select("page", "at", none(ours, "key"), "font", F.lit(False).alias("own")))
    of_page, place = Window.partitionBy("page"), Window.partitionBy("page", "at")
    placed = dealt_by(both.where("page is not null"), "page").select(
        "page", "at", "key", "own", F.count_if("own").over(of_page).alias("n"), F.count_if(~F.col("own")).over(of_page).alias("m"), F.min("font").over(place).alias("low"), F.max("font").over(place).alias("high"),
        F.count_if(~F.col("own")).over(place).alias("there"), F.count_if(~F.col("own") & F.col("font").isNull()).over(place).alias("without"),
    )
    met = placed.where("own and n = m and at is not null and there > 0").groupBy("page", "key").agg(F.min("low").alias("font"), F.max("high").alias("other"), F.max("without").alias("none"))
    bad = F.coalesce(F.col("key").isNull() | (F.col("none") > 0) | (F.col("font") != F.col("other")), F.lit(False))
    return met.withColumn("bad", F.max(bad).over(of_page)).where("not bad").select("page", "key", "font")


def alignments(lines: DataFrame, width: float) -> DataFrame:
    """(page, id, align) of lines (page, id, x, y, width, size, text) on pages of this width: justify, right, center or left, told from the lines around.

    Right ends and baselines are met in buckets: lines that end together by page and end, lines of one row by page and height.
    """
    l = lines.where(F.btrim("text") != "").withColumn("r", F.col("x") + F.col("width"))  # noqa: E741
    l = l.withColumn("farthest", F.max("r").over(Window.partitionBy("page"))).withColumn("biggest", F.max("size").over(Window.partitionBy("page")))  # noqa: E741
    other = l.select("page", F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("r").alias("orr"))
    band = lambda c, w: F.floor(c / w)
    three = lambda b: F.explode(F.array(b - 1, b, b + 1)).alias("b")
    ends = l.select("*", three(band(F.col("r"), 1.5))).join(other.withColumn("b", band(F.col("orr"), 1.5)), ["page", "b"]).where((F.col("oid") != F.col("id")) & (F.abs(F.col("oy") - F.col("y")) >= 0.3 * F.col("size")) & (F.abs(F.col("orr") - F.col("r")) < 1.5))
    at_end = ends.groupBy("page", "id").agg(
        F.bool_or((F.abs(F.col("ox") - F.col("x")) < 1) & (F.abs(F.col("oy") - F.col("y")) < 4 * F.col("size"))).alias("near"), F.bool_or(F.abs(F.col("ox") - F.col("x")) > 1).alias("ragged"), F.lit(True).alias("ends"),
    )
    tall = l.select("page", "biggest").distinct()
    rows = l.select("*", three(band(F.col("y"), F.col("biggest")))).join(other.join(tall, "page").select("page", "oid", "ox", "oy", band(F.col("oy"), F.col("biggest")).alias("b")), ["page", "b"]).where((F.col("oid") != F.col("id")) & (F.abs(F.col("oy") - F.col("y")) < 0.3 * F.col("size")))
    in_row = rows.groupBy("page", "id").agg(F.bool_or(F.col("ox") < F.col("x")).alias("left_of"), F.bool_or(F.col("ox") > F.col("x")).alias("right_of"), F.bool_and(F.col("ox") < F.col("x")).alias("all_left"), F.lit(True).alias("row"))
    d = l.join(at_end, ["page", "id"], "left").join(in_row, ["page", "id"], "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    spaces = F.length("text") - F.length(F.replace(F.btrim("text"), F.lit(" "), F.lit(""))) - (F.length("text") - F.length(F.btrim("text")))
    far = (F.col("r") > width * 0.55) & (F.col("x") > width * 0.4)
    right = is_("ragged") | ~is_("ends") & (F.col("r") >= F.col("farthest") - 1.5) & ~is_("right_of") | is_("left_of") & is_("all_left") & is_("ends")
    centre = ~is_("row") & (F.abs(F.col("x") + F.col("width") / 2 - width / 2) < 2) & (F.col("x") > width * 0.15)
    align = F.when(is_("near") & (spaces >= 3) & (F.col("width") > 0.5 * width), "justify").when(far & right, "right").when(centre, "center").otherwise("left")
    return d.select("page", "id", align.alias("align"))


#: A content stream's tokens: comments, strings (brackets may nest), dictionaries, hexadecimal strings, brackets, names, and what stands between.
TOKEN = re.compile(r"(?P<skip>[\x00\t\n\x0c\r ]+|%[^\r\n]*|[{}>])|(?P<open>\()|(?P<dict><<)|(?P<hex><[^>]*>?)|(?P<arr>[\[\]])|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)", re.DOTALL)
STRING_PART = re.compile(r"\\(?:[0-7]{1,3}|\r\n|.)|[()]|[^\\()]+", re.DOTALL)
DICT_PART = re.compile(r"<<|>>|\(", re.DOTALL)
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
IMAGE_END = re.compile(r"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ]|\Z)")


def string_end(text: str, at: int) -> int:
    """Where the string that opens before `at` ends."""
    depth = 1
    while depth and (m := STRING_PART.match(text, at)):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        at = m.end()
    return at


def dict_end(text: str, at: int) -> int:
    depth = 1
    while depth and (m := DICT_PART.search(text, at)):
        depth += {"<<": 1, ">>": -1}.get(m[0], 0)
        at = string_end(text, m.end()) if m[0] == "(" else m.end()
    return len(text) if depth else at


def operations(text: str) -> list[tuple[str, list[str], int, int]]:
    """The operators of a content stream: name, operands as they are written, where the first one starts and the operator ends."""
    out, operands, start, depth, at = [], [], -1, 0, 0
    opened = 0
    while m := TOKEN.match(text, at):
        kind, first = m.lastgroup, at
        at = m.end()
        if kind == "skip" or kind == "other":
            continue
        if kind == "open":
            at = string_end(text, at)
        elif kind == "dict":
            at = dict_end(text, at)
        if kind == "arr":
            if not depth:
                opened = first
                start = first if start < 0 else start
            depth = max(0, depth + (1 if m[0] == "[" else -1))
            if not depth:
                operands.append(text[opened:at])
            continue
        if kind == "word" and not NUMBER.match(m[0]) and m[0] not in ("true", "false", "null"):
            out.append((m[0], operands, start if start >= 0 else first, at))
            operands, start, depth = [], -1, 0
            if m[0] == "ID":  # an inline image: what follows is no text
                end = IMAGE_END.search(text, at + 1)
                at = end.start() if end else max(at, len(text) - 2)
            continue
        if not depth:
            start = first if start < 0 else start
            operands.append(text[first:at])
    return out


#: Streams up to this many characters, as forms repeat them, are parsed once for pages that share them.
SHORT = 4_000


@lru_cache(maxsize=256)
def short_operations(text: str) -> list[tuple[str, list[str], int, int]]:
    return operations(text)


def stream_operations(streams: DataFrame) -> DataFrame:
    """(page, i, op, args, start, end) of content streams (page, stream: Latin-1 text): a row for each operator, args as they are written."""
    kind = dict(streams.dtypes)["page"]
    names, types = ["i", "op", "args", "start", "end"], [pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []

            def full() -> pa.RecordBatch:
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), *found], ["page", *names])  # noqa: B023

            for at, text in enumerate(batch.column(1).to_pylist()):
                ops = (short_operations if len(text or "") <= SHORT else operations)(text or "")
                for first in range(0, len(ops), 10_000):
                    part = ops[first : first + 10_000]
                    of.extend([at] * len(part))
                    rows.extend((first + i, *op) for i, op in enumerate(part))
                    if len(rows) >= 10_000:
                        yield full()
                        of, rows = [], []
            if rows:
                yield full()

    return streams.select("page", "stream").mapInArrow(parsed, f"page {kind}, i int, op string, args array<string>, start int, end int")


def image_uses(pages: DataFrame, uses: DataFrame, masks: DataFrame, deepest: int = 4) -> DataFrame:
    """(image, longest): the images that pages (page, long) use (owner, kind, ref), straight or in forms within forms, `deepest` deep, but for masks (ref); with the longest side of a page that uses them."""
    front = pages.select(F.col("page").alias("owner"), "long")
    found = None
    for _ in range(deepest + 1):
        met = front.join(uses, "owner").groupBy("kind", "ref").agg(F.max("long").alias("long"))
        here = met.where("kind = 'image'").select("ref", "long")
        found = here if found is None else found.union(here)
        front = met.where("kind = 'form'").select(F.col("ref").alias("owner"), "long")
    return found.join(masks, "ref", "left_anti").groupBy(F.col("ref").alias("image")).agg(F.max("long").alias("longest"))
