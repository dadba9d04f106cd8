"""Lines of a page judged: whether and how they can be edited, which runs painted them, fonts known by name, and whether a move has arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.fonts import legacy_hindi
from pagewright.functions.scripts import has_indic, malformed

# Letters that need a shaping engine, scripts of India and marks that are left out before, characters without meaning, symbols; shares of the size within which runs and lines meet.
SHAPED = r"[\x{0590}-\x{08FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{A8E0}-\x{A8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
INDIC = r"[\x{0900}-\x{0D7F}\x{A8E0}-\x{A8FF}\x{1CD0}-\x{1CFF}\x{200B}-\x{200D}\x{25CC}]"
BAD = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0}-\x{8}\x{E}-\x{1F}]"
SYMBOL = r"^[\x{E000}-\x{F8FF}\s]+$"
SLANT, BASE, BEFORE, WITHIN, BEYOND, UPRIGHT = 0.02, 0.3, 0.3, 0.05, 0.6, 1e-3
#: How near, in sizes, a moved line must be to where it should be.
ACROSS, UP = 0.5, 0.35


def classified(lines: DataFrame) -> DataFrame:
    """lines (text, font, vertical, type3, a, b, c, d, size, readable: the old Hindi fonts that can be read) with kind, editable and verify.

    kind: vertical, turned, drawn (a Type 3 font), legacy, script, garbled, symbol, unreliable or plain; the first that
    holds. A legacy font that can be read and garbled text are editable once verified; plain text is editable; nothing
    else is. Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    turned = (F.abs("b") > SLANT * F.col("size")) | (F.abs("c") > SLANT * F.col("size")) | (F.col("a") <= 0) | (F.col("d") <= 0)
    legacy = F.coalesce(legacy_hindi(F.col("font")), F.lit(""))
    kind = F.when(F.col("vertical"), "vertical").when(turned, "turned").when(F.col("type3"), "drawn").when(legacy != "", "legacy").when(F.regexp_replace(text, INDIC, "").rlike(SHAPED), "script")
    kind = kind.when(has_indic(text) & malformed(text), "garbled").when(text.rlike(SYMBOL) & (F.length(F.btrim(text)) <= 3), "symbol").when(text.rlike(BAD), "unreliable").otherwise("plain")
    verify = F.when((F.col("kind") == "legacy") & F.coalesce(F.array_contains("readable", legacy), F.lit(False)), "legacy").when(F.col("kind") == "garbled", "garbled")
    return lines.withColumn("kind", kind).withColumn("verify", verify).withColumn("editable", (F.col("kind") == "plain") | F.col("verify").isNotNull())


def bare(text: Column) -> Column:
    """A text as runs and lines are compared: without white space. Compatibility forms aren't folded."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def painted_by(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(page, line, ok, reason, runs) of lines (page, line, x, y, end, size, text, fonts): the runs (page, run, font, b, c, x, y, end, known, text, codes: without spaces) that painted each, in order.

    Runs of the line's fonts that stand upright on its baseline and start within it. reason: not-found, unknown-font,
    shared-run (one reaches beyond the line's end) or text-mismatch; runs without text must have as many codes as the
    line has letters. Lines meet runs by page, font and bands of the baseline.
    """
    band = lambda c: F.floor(F.col(c) / F.col("_w"))
    tall = lines.groupBy("page").agg((2 * BASE * F.max("size")).alias("_w"))
    l = lines.join(tall, "page").select("page", "line", "x", F.col("y").alias("ly"), F.col("end").alias("le"), "size", F.explode("fonts").alias("font"), band("y").alias("_at"))  # noqa: E741
    l = l.withColumn("_b", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)))  # noqa: E741
    r = runs.join(tall, "page").select("page", "run", "font", "b", "c", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("end").alias("re"), "known", F.col("text").alias("said"), "codes", band("y").alias("_b"))
    upright = (F.abs("b") < UPRIGHT * F.col("size")) & (F.abs("c") < UPRIGHT * F.col("size"))
    met = l.join(r, ["page", "font", "_b"]).where(upright & (F.abs(F.col("ry") - F.col("ly")) <= BASE * F.col("size")) & (F.col("rx") >= F.col("x") - BEFORE * F.col("size")) & (F.col("rx") <= F.col("le") - WITHIN * F.col("size")))
    bad = F.when(~F.col("known"), "unknown-font").when(F.col("re") > F.col("le") + BEYOND * F.col("size"), "shared-run")
    of = met.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("run", "said"))).alias("r"), F.min_by(bad, F.when(bad.isNotNull(), F.col("run"))).alias("bad"), F.sum("codes").alias("codes"))
    got = bare(F.array_join(F.transform("r", lambda x: F.coalesce(x["said"], F.lit(""))), ""))
    out = lines.select("page", "line", "text").join(of, ["page", "line"], "left")
    same = F.when(got != "", got == bare(F.col("text"))).otherwise(F.col("codes") == F.length(bare(F.col("text"))))
    reason = F.when(F.col("r").isNull(), "not-found").when(F.col("bad").isNotNull(), F.col("bad")).when(~same, "text-mismatch")
    return out.select("page", "line", reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), F.transform("r", lambda x: x["run"])).alias("runs"))


def fonts_by_name(fonts: DataFrame, known: DataFrame) -> DataFrame:
    """(page, key, font) of fonts (page, key, names) whose names all lead to one font of known (page, name, font); ambiguous ones aren't mapped."""
    met = fonts.select("page", "key", F.explode("names").alias("name")).join(known, ["page", "name"])
    of = met.groupBy("page", "key").agg(F.min("font").alias("font"), F.max("font").alias("_f"))
    return of.where(F.col("font") == F.col("_f")).select("page", "key", "font")


def arrived(moves: DataFrame, items: DataFrame) -> DataFrame:
    """(page, line, ok) of moved lines (page, line, text, x, y, size: where they should be): an item (page, text, x, y) of the page as it is now stands there and holds the text, starts it, or is a start of it. Lines without text have arrived. Lines meet items in bands of the height."""
    tall = moves.groupBy("page").agg(F.max("size").alias("_w"))
    m = moves.join(tall, "page").select("page", "line", "size", F.col("x").alias("mx"), F.col("y").alias("my"), bare(F.col("text")).alias("want"), F.floor(F.col("y") / F.col("_w")).alias("_at"))
    i = items.join(tall, "page").select("page", "x", "y", bare(F.col("text")).alias("t"), F.floor(F.col("y") / F.col("_w")).alias("_b")).where("t <> ''")
    near = (F.abs(F.col("x") - F.col("mx")) < ACROSS * F.col("size")) & (F.abs(F.col("y") - F.col("my")) < UP * F.col("size"))
    holds = F.contains("t", "want") | F.startswith("want", "t")
    hit = m.withColumn("_b", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).join(i, ["page", "_b"]).where(near & holds).select("page", "line").distinct().withColumn("hit", F.lit(True))
    return m.join(hit, ["page", "line"], "left").select("page", "line", (F.coalesce("hit", F.lit(False)) | (F.col("want") == "")).alias("ok"))
