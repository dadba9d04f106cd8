"""Text items of a page grouped into lines: runs that go on, justified lines joined again, words of Indic scripts that change fonts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scripts import has_indic
from pagewright.operators.streams import sent, values

# Fixed values, in sizes: the smallest size; what differs in size or slant; off the baseline; how far back and on a run goes; a word's gap; a wide gap.
LEAST, SLANT, OFF, BACK, ON, WORD, WIDE = 1.0, 0.02, 0.2, 0.35, 1.1, 0.12, 1.0
#: A justified line's widest gap with several gaps and with one, and how much its gaps differ, in points or of the widest.
SEVERAL, SINGLE, EVEN, EVEN_PART = 3.0, 1.5, 0.6, 0.12
#: Items of Indic scripts: what differs in size and baseline, and the gaps from and to which they are one word.
INDIC_SIZE, OVERLAP, INDIC_GAP = 0.05, 0.2, 0.35
SPACE = r"[\s\x{00A0}\x{FEFF}]"


#: What a run is told by, beside its page, number, text and reach.
PLACE = ("font", *"efabcd", "ux", "uy", "size")
#: Runs and lines of a batch on the way back.
BATCH = 10_000


def ahead(of: dict, e: float, f: float) -> tuple[float, float]:
    """How far an item's origin is along a run's baseline from the run's, and how far off it."""
    dx, dy = e - of["e"], f - of["f"]
    return dx * of["ux"] + dy * of["uy"], dy * of["ux"] - dx * of["uy"]


def alike(of: dict, off: float, font: str | None, size: float, b: float, c: float) -> bool:
    """Same font, size and slant, and on the baseline."""
    near = SLANT * size
    return font is not None and font == of["font"] and abs(size - of["size"]) < near and abs(b - of["b"]) < near and abs(c - of["c"]) < near and abs(off) < OFF * size


def run_step(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items, which come by page and in order, to runs: only the open run and the one before a wide gap are held."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, line, open_, wide, last, out = object(), 0, None, None, None, []
        told = lambda r: (r["page"], r["line"], "".join(r["text"]), *[r[c] for c in PLACE], r["width"], r["follows"])
        for batch in batches:
            for of, text, font, e, f, a, b, c, d, ux, uy, size, width, eol, blank, ends, opens in values(batch, ("page", "text", *PLACE, "width", "eol", "blank", "ends", "opens")):
                if of != page:
                    page, line, open_, wide = of, 0, None, None
                if text == "" or size < LEAST:
                    if eol:
                        open_ = wide = None
                    continue
                if blank and width > WIDE * size:
                    open_, wide = None, open_ or wide
                    continue
                if open_:
                    along, off = ahead(open_, e, f)
                    reach = open_["width"]
                    if alike(open_, off, font, size, b, c) and along >= reach - BACK * size and along - reach <= ON * size:
                        if along - reach > WORD * size and not open_["ends"] and not opens:
                            open_["text"].append(" ")
                        open_["text"].append(text)
                        open_["width"], open_["ends"] = max(reach, along + width), ends
                        if eol:
                            open_ = None
                        continue
                if not blank:
                    if last:
                        out.append(told(last))
                    follows = False
                    if wide:
                        along, off = ahead(wide, e, f)
                        follows = alike(wide, off, font, size, b, c) and along > wide["width"]
                    last = open_ = {"page": of, "line": line, "text": [text], "font": font, "e": e, "f": f, "a": a, "b": b, "c": c, "d": d, "ux": ux, "uy": uy, "size": size, "width": width, "ends": ends, "follows": follows}
                    line, wide = line + 1, None
                if eol:
                    open_ = wide = None
            if len(out) >= BATCH:
                yield sent(out, batch.schema.field("page").type, schema)
                out = []
        if last:
            yield sent([*out, told(last)], batch.schema.field("page").type, schema)

    return folded


def text_runs(items: DataFrame) -> DataFrame:
    """(page, line, text, font, e, f, a, b, c, d, ux, uy, size, width, follows) of items (page, seq, text, font, a to f, width, eol): runs of items that go on, numbered down the page; follows: a run of the same font came before a wide gap on its baseline.

    An item goes on in the open run if font, size, slant and baseline are the same and it starts where the run ends,
    more or less; how far the run reaches grows as it goes. Blank items wider than the size part runs, others are part of
    one. A page's items are in one partition, sorted; they stream through.
    """
    kind = dict(items.dtypes)["page"]
    text = F.coalesce("text", F.lit(""))
    by = F.when(F.hypot("a", "b") == 0, 1.0).otherwise(F.hypot("a", "b"))
    taken = items.select("page", "seq", text.alias("text"), "font", *[F.col(c).cast("double").alias(c) for c in (*"abcdef", "width")], F.coalesce("eol", F.lit(False)).alias("eol"))
    placed = taken.repartition("page").sortWithinPartitions("page", "seq", "text", "font", *"abcdef", "width", "eol")
    told = [F.hypot("c", "d").alias("size"), (F.col("a") / by).alias("ux"), (F.col("b") / by).alias("uy"), F.col("text").rlike(f"^{SPACE}*$").alias("blank"), F.col("text").rlike(f"{SPACE}$").alias("ends"), F.col("text").rlike(f"^{SPACE}").alias("opens")]
    made = [("line", pa.int32()), ("text", pa.string()), ("font", pa.string()), *[(c, pa.float64()) for c in (*PLACE[1:], "width")], ("follows", pa.bool_())]
    return placed.select("*", *told).drop("seq").mapInArrow(run_step(pa.schema(made)), f"page {kind}, line int, text string, font string, {', '.join(f'{c} double' for c in (*PLACE[1:], 'width'))}, follows boolean")


def without_start(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def without_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def justified(runs: DataFrame) -> DataFrame:
    """runs (text_runs) with chains of runs parted by wide gaps joined to one line where the gaps are about the same and not too wide; table cells stay apart. Chains are islands of the runs that follow."""
    down = Window.partitionBy("page").orderBy("line")
    before = lambda c: F.lag(c).over(down)
    gap = (F.col("e") - before("e")) * before("ux") + (F.col("f") - before("f")) * before("uy") - before("width")
    linked = runs.withColumn("gap", F.when(F.col("follows"), gap)).withColumn("chain", F.sum((~F.col("follows")).cast("int")).over(down))
    of = Window.partitionBy("page", "chain")
    n, most, least = F.count("gap").over(of), F.max("gap").over(of), F.min("gap").over(of)
    size = F.min_by("size", "line").over(of)
    joins = F.coalesce((n > 0) & (most <= F.when(n > 1, SEVERAL).otherwise(SINGLE) * size) & (most - least <= F.greatest(F.lit(EVEN), EVEN_PART * most)), F.lit(False))
    linked = linked.withColumn("into", F.when(joins, F.min("line").over(of)).otherwise(F.col("line")))
    own = ("text", *PLACE, "width")
    parts = F.array_sort(F.collect_list(F.struct("line", *own)))
    out = linked.groupBy("page", F.col("into")).agg(parts.alias("p")).select("page", F.col("into").alias("line"), "p", F.element_at("p", -1).alias("l"), *[F.get("p", F.lit(0))[c].alias(c) for c in own[1:]])
    inner = lambda p, i: F.when(i == 0, without_end(p["text"])).when(i == F.size("p") - 1, without_start(p["text"])).otherwise(without_start(without_end(p["text"])))
    words = F.transform("p", lambda p, i: F.when(F.size("p") == 1, p["text"]).otherwise(inner(p, i)))
    reach = F.when(F.size("p") > 1, (F.col("l.e") - F.col("e")) * F.col("ux") + (F.col("l.f") - F.col("f")) * F.col("uy") + F.col("l.width")).otherwise(F.col("width"))
    return out.withColumn("text", F.array_join(words, " ")).withColumn("width", reach).drop("p", "l")


def join_step(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines, which come by page and in order, with neighbours joined: only the line under way is held."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = None, []
        told = lambda s: (s["page"], s["line"], "".join(s["text"]), s["e"], s["f"], s["size"], s["width"], list(dict.fromkeys(s["fonts"])))
        for batch in batches:
            for page, line, text, font, e, f, b, c, size, width, indic, latin, ends, opens, odd in values(batch, ("page", "line", "text", "font", *"efbc", "size", "width", "indic", "latin", "ends", "opens", "odd")):
                if s and s["page"] == page and (indic or s["indic"]) and (s["indic"] or not s["latin"]) and (indic or not latin) and not s["odd"] and not odd:
                    of, gap = s["size"], e - (s["e"] + s["width"])
                    flat = all(abs(v) <= SLANT * of for v in (s["b"], s["c"], b, c))
                    if flat and abs(size - of) <= INDIC_SIZE * of and abs(f - s["f"]) <= INDIC_SIZE * of and -OVERLAP * of <= gap <= INDIC_GAP * of:
                        s["text"] += [" ", text] if gap > WORD * of and not s["ends"] and not opens else [text]
                        s["fonts"].append(font)
                        s.update(width=max(s["width"], e + width - s["e"]), indic=s["indic"] or indic, latin=s["latin"] or latin, ends=ends)
                        continue
                if s:
                    out.append(told(s))
                s = {"page": page, "line": line, "text": [text], "fonts": [font], "e": e, "f": f, "b": b, "c": c, "size": size, "width": width, "indic": indic, "latin": latin, "ends": ends, "odd": odd}
            if len(out) >= BATCH:
                yield sent(out, batch.schema.field("page").type, schema)
                out = []
        if s:
            yield sent([*out, told(s)], batch.schema.field("page").type, schema)

    return folded


def engine_lines(items: DataFrame, odd_fonts: list[str] | None = None) -> DataFrame:
    """(page, line, text, x, y, size, width, fonts) of items (page, seq, text, font, a to f: the matrix, width, eol): the lines of a page as they are read and edited; lines without text are left out.

    Runs are put together, justified lines joined again, and neighbouring runs of one baseline joined if Indic text is in
    one of them and Latin letters only in one that has some. Lines in odd_fonts (drawn fonts) aren't joined. Items without a
    font or with a null text count as empty. What a line takes in hangs on what it has taken in: in both steps a page's
    rows stream through a task in order; the chains are windows.
    """
    lines = justified(text_runs(items))
    kind = dict(lines.dtypes)["page"]
    odd = F.col("font").isin(odd_fonts) if odd_fonts else F.lit(False)
    flags = [has_indic(F.col("text")).alias("indic"), F.col("text").rlike("[A-Za-z]").alias("latin"), F.col("text").rlike(f"{SPACE}$").alias("ends"), F.col("text").rlike(f"^{SPACE}").alias("opens"), F.coalesce(odd, F.lit(False)).alias("odd")]
    # the windows of justified have each page in one partition
    placed = lines.sortWithinPartitions("page", "line").select("page", "line", "text", "font", *"efbc", "size", "width", *flags)
    made = [("line", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "size", "width")], ("fonts", pa.list_(pa.string()))]
    out = placed.mapInArrow(join_step(pa.schema(made)), f"page {kind}, line int, text string, x double, y double, size double, width double, fonts array<string>").withColumn("text", without_end(F.col("text")))
    return out.where(~F.col("text").rlike(f"^{SPACE}*$"))
