"""Lines met with lines: neighbours, copies, running lines by place, spacing, clips, pictures, scores of headings and résumés, steps that fit, learned glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fonts
from pagewright.functions.scalars import js_round, let, mask_digits, running

# Sizes of a photograph in points and its place.
PHOTO = {"side": (40, 300), "shape": (0.7, 1.4), "top": 0.4, "left": 0.35, "width": 0.6}


def near_bands(rows: DataFrame, value: str, width: Column | float) -> DataFrame:
    """rows once for each of three bands of the value, _b: its own and those beside it."""
    b = F.floor(F.col(value) / width)
    return rows.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))


def nearest_baselines(lines: DataFrame) -> DataFrame:
    """(page, id, dy) of lines (page, id, x, y, width, size) that stand off a baseline: the step to that of the line which is nearest by gap and four times the height, within 0.6 sizes."""
    lines = lines.withColumn("_w", F.max("size").over(Window.partitionBy("page")))
    other = lines.select("page", F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("width").alias("ow"), F.floor(F.col("y") / F.col("_w")).alias("_b"))
    dy = F.col("oy") - F.col("y")
    met = near_bands(lines, "y", F.col("_w")).join(other, ["page", "_b"]).where((F.col("oid") != F.col("id")) & (F.abs(dy) <= 0.6 * F.col("size")) & (F.abs(dy) >= 0.01))
    gap = F.greatest(F.lit(0.0), F.col("ox") - (F.col("x") + F.col("width")), F.col("x") - (F.col("ox") + F.col("ow")))
    return met.groupBy("page", "id").agg(F.min(F.struct((gap + 4 * F.abs(dy)).alias("k"), "oid", dy.alias("dy"))).alias("m")).select("page", "id", F.col("m.dy").alias("dy"))


def same_lines(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page, id, other) of two analyses of pages (page, id, text, x, y): the first line of the same text within half a point."""
    band = lambda c: F.floor(F.col(c) / 0.5)
    t = theirs.select("page", F.col("id").alias("other"), "text", F.col("x").alias("ox"), F.col("y").alias("oy"), band("y").alias("_b"))
    met = near_bands(ours, "y", 0.5).join(t, ["page", "text", "_b"]).where((F.abs(F.col("ox") - F.col("x")) < 0.5) & (F.abs(F.col("oy") - F.col("y")) < 0.5))
    return met.groupBy("page", "id").agg(F.min("other").alias("other"))


def placed_running_lines(lines: DataFrame, height: float) -> DataFrame:
    """(page, id) of lines (page, id, text, x, y, width, size) in the margins (12 % below, 10 % above) whose text, with numbers masked, also stands there on the page before or after: same height within a point, size within 0.3, and one end within two."""
    edge = lines.where((F.btrim("text") != "") & ((F.col("y") < 0.12 * height) | (F.col("y") > 0.9 * height)))
    edge = edge.select("page", "id", "x", "y", "width", "size", F.xxhash64(F.lit("a"), mask_digits(F.col("text"))).alias("h1"), F.xxhash64(F.lit("b"), mask_digits(F.col("text"))).alias("h2"))
    other = edge.select(F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), "h1", "h2", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("width").alias("ow"), F.col("size").alias("os"))
    ends = (F.abs(F.col("ox") - F.col("x")) < 2) | (F.abs(F.col("ox") + F.col("ow") - F.col("x") - F.col("width")) < 2)
    return edge.join(other, ["page", "h1", "h2"]).where((F.abs(F.col("oy") - F.col("y")) < 1) & (F.abs(F.col("os") - F.col("size")) < 0.3) & ends).select("page", "id").distinct()


def shown_lines(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The lines (page, id, x, y, width, size) but those that overlap runs (page, x0, x1, y, hidden) which are all hidden."""
    lines = lines.withColumn("_w", F.max("size").over(Window.partitionBy("page")))
    tall = lines.select("page", "_w").distinct()
    r = runs.join(tall, "page").select("page", "x0", "x1", F.col("y").alias("ry"), "hidden", F.floor(F.col("y") / F.col("_w")).alias("_b"))
    on = (F.abs(F.col("ry") - F.col("y")) < 0.45 * F.col("size")) & (F.least(F.col("x1"), F.col("x") + F.col("width")) - F.greatest("x0", "x") > 0.2 * F.col("size"))
    gone = near_bands(lines, "y", F.col("_w")).join(r, ["page", "_b"]).where(on).groupBy("page", "id").agg(F.bool_and("hidden").alias("h")).where("h")
    return lines.drop("_w").join(gone, ["page", "id"], "left_anti")


def gaps_above(lines: DataFrame, by: str = "page") -> DataFrame:
    """lines (y) with gap: the step from the line before, down the page; 99 for the first."""
    down = Window.partitionBy(by).orderBy(F.desc("y"), "id")
    return lines.withColumn("gap", F.coalesce(F.lag("y").over(down) - F.col("y"), F.lit(99.0)))


def wrap_leading(steps: DataFrame, lead: DataFrame) -> DataFrame:
    """(page, wrap): the smallest step (page, step) that comes twice or more, rounded to halves, and isn't over the page's leading by more than a quarter point."""
    counts = steps.groupBy("page", (js_round(F.col("step") * 2) / 2).alias("q")).agg(F.count("*").alias("n")).where("n >= 2")
    return counts.join(lead, "page").where(F.col("q") <= F.col("lead") + 0.25).groupBy("page").agg(F.min("q").alias("wrap"))


def photographs(images: DataFrame) -> DataFrame:
    """(doc, image) of images (doc, image, x, y, w, h, page_w, page_h; y up): the largest that is shaped and placed as a photograph."""
    low, high = PHOTO["side"]
    shape = F.col("w") / F.col("h")
    placed = (F.col("page_h") - (F.col("y") + F.col("h")) <= PHOTO["top"] * F.col("page_h")) | (F.col("x") + F.col("w") < PHOTO["left"] * F.col("page_w"))
    fit = images.where(F.col("w").between(low, high) & F.col("h").between(low, high) & shape.between(*PHOTO["shape"]) & placed & (F.col("w") < PHOTO["width"] * F.col("page_w")))
    return fit.groupBy("doc").agg(F.min(F.struct((-F.col("w") * F.col("h")).alias("k"), "image")).alias("m")).select("doc", F.col("m.image").alias("image"))


def heading_scores(lines: DataFrame, body: DataFrame) -> DataFrame:
    """lines (doc, id, text, section, bold, size, gap) with score and heading: 2 for a known heading and 1 each for weight or capitals, size, four words at most, a gap and no full stop; it is one from 3 on."""
    text = F.col("text")
    caps = text.rlike("[A-Z]{3}") & ~text.rlike("[a-z]")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    score = 2 * one(F.col("section").isNotNull()) + one(F.col("bold") | caps) + one(F.col("size") >= F.col("body") + 1) + one(F.size(F.split(text, r"\s+")) <= 4) + one(F.col("gap") >= 1.44 * F.col("size")) + one(~text.rlike(r"[.]$"))
    return lines.join(body, "doc").withColumn("score", score).withColumn("heading", F.col("section").isNotNull() & (F.col("score") >= 3)).drop("body")


def likeness(docs: DataFrame) -> DataFrame:
    """docs (n_pages, contact, sections: kinds, photo) with score and is_resume: 1 for two pages at most, 2 for a contact, 1 for each of three kinds of sections, 1 for a photo, 1 for work or education beside another kind; high from 6, unsure from 4."""
    kinds = F.array_distinct("sections")
    both = (F.size(kinds) >= 2) & F.arrays_overlap(kinds, F.array(F.lit("work"), F.lit("education")))
    score = (F.col("n_pages") <= 2).cast("long") + 2 * F.col("contact").cast("long") + F.least(F.lit(3), F.size(kinds)).cast("long") + F.col("photo").cast("long") + both.cast("long")
    return docs.withColumn("score", score).withColumn("is_resume", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 4, "unsure").otherwise("no"))


def lost_runs(lines: DataFrame) -> DataFrame:
    """(doc, first, n) of lines (doc, id, text, placed, skipped): runs of lines that came nowhere, of three at least or with one of 60 characters; skipped lines neither join nor part runs."""
    order = Window.partitionBy("doc").orderBy("id")
    kept = lines.where("not skipped").withColumn("run", F.sum(F.col("placed").cast("int")).over(order)).where("not placed")
    return kept.groupBy("doc", "run").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).where("n >= 3 or longest >= 60").select("doc", "first", "n")


def fitting_step(steps: DataFrame, size: str, most: str) -> DataFrame:
    """(doc, step, status) of what steps (doc, step from 0, size, most) come to: already where step 0 fits, no where the last doesn't, else yes with the first that fits. Sizes fall with the steps."""
    fits = F.col(size) <= F.col(most)
    told = steps.groupBy("doc").agg(F.min(F.when(fits, F.col("step"))).alias("first"), F.max_by(fits, "step").alias("last"))
    status = F.when(F.col("first") == 0, "already").when(F.col("last"), "yes").otherwise("no")
    return told.select("doc", F.when(status == "yes", F.col("first")).alias("step"), status.alias("status"))


def styled_siblings(lines: DataFrame, fonts_of: DataFrame) -> DataFrame:
    """(page, id, key) of lines (page, id, font, bold, italic: the wanted style): the first font (page, at, key, font, embedded) of the line's font's family, embedded or not as it is, that has the style."""
    named = fonts_of.select("page", "at", "key", "embedded", fonts.family(fonts.normal_name(F.col("font"))).alias("family"), fonts.traits(F.col("font")).alias("t"), F.col("font"))
    own = named.select("page", "font", F.col("family").alias("f"), F.col("embedded").alias("e")).distinct()
    wanted = named.select("page", F.col("family").alias("f"), F.col("embedded").alias("e"), F.col("t.bold").alias("bold"), F.col("t.italic").alias("italic"), "at", "key")
    met = lines.join(own, ["page", "font"]).join(wanted, ["page", "f", "e", "bold", "italic"])
    return met.groupBy("page", "id").agg(F.min_by("key", "at").alias("key"))


def learned_glyphs(seen: DataFrame) -> DataFrame:
    """(src, font, key, text, n, conflict) of observations (src, font, key, text): how often a glyph was seen as its text; two texts are a conflict for good, with the least and how often all were seen."""
    return seen.groupBy("src", "font", "key").agg(F.min("text").alias("text"), F.count("*").alias("n"), (F.min("text") != F.max("text")).alias("conflict"))


def item_shifts(items: DataFrame, shifts: list[dict], tol: float = 1.0) -> DataFrame:
    """items (x0, y0, x1, y1, path, painted) with dy: shifts {x0, x1, low, high, dy} one after another, each tested where those before have moved the item; a path only moves if it starts in the region, poking out little."""
    every = F.array(*[F.struct(*[F.lit(float(s[k])).alias(k) for k in ("x0", "x1", "low", "high", "dy")]) for s in shifts])
    poke = F.when(F.col("painted"), F.least(0.5 * (F.col("y1") - F.col("y0")), F.lit(6.0))).otherwise(F.lit(0.1))

    def step(dy: Column, s: Column) -> Column:
        middle = (F.col("y0") + F.col("y1")) / 2 + dy
        inside = (F.col("x0") >= s["x0"] - tol) & (F.col("x1") <= s["x1"] + tol) & middle.between(s["low"], s["high"])
        return F.when(inside & (~F.col("path") | (F.col("y1") + dy <= s["high"] + poke)), dy + s["dy"]).otherwise(dy)

    return items.withColumn("dy", F.aggregate(every, F.lit(0.0), step))


def wrapped(rows: DataFrame, char_width: float, room: str, text: str = "text") -> DataFrame:
    """rows with wrapped: the text's words in lines that fit in `room`, a quarter point more at most; words have a fixed width a character."""
    words = F.filter(F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")

    def lines(w: Column) -> Column:
        # the state after each word: characters of its line, and the line's number
        add = lambda s, n: F.when((s["line"] >= 0) & ((s["n"] + 1 + n) * char_width <= F.col(room) + 0.25), F.struct((s["n"] + 1 + n).alias("n"), s["line"].alias("line"))).otherwise(F.struct(n.alias("n"), (s["line"] + 1).alias("line")))
        at = F.transform(running(F.transform(w, F.length), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("line")), add), lambda s: s["line"])
        return let(at, lambda a: broken(w, a))

    def broken(w: Column, a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) < x), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda i, k: F.array_join(F.slice(w, i + 1, F.coalesce(F.get(s, k + 1), F.size(w)) - i), " ")))

    return rows.withColumn("wrapped", F.when(F.col(text).isNotNull(), let(words, lines)))


def repointed(refs: DataFrame, copies: DataFrame) -> DataFrame:
    """refs (owner, ref) with ref led through copies (ref, first)."""
    return refs.join(copies, "ref", "left").select("owner", F.coalesce("first", "ref").alias("ref"))


def dictionary_key(entries: Column) -> Column:
    """A dictionary's key: its entries but the length, sorted, as name=value between bars."""
    kept = F.filter(F.map_entries(entries), lambda e: e["key"] != "/Length")
    return F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
