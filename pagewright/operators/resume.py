"""Keywords, headings and the parser-safety score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.resume_text import BULLET, LONE_BULLET, heading
from pagewright.functions.scalars import clean, js_round

# Words that are no keywords, and penalties by the level of a risk.
STOP = (
    "the and for with you our your are will that this from have has who what all can work team teams able strong role into across using use build building other more years year about such they "
    "their them must should would we us an a of to in on at by or as is be it its not plus also well new including within experience skills ability knowledge understanding responsibilities "
    "requirements preferred required looking join company help ensure etc"
).split()
PENALTY = {"high": 18, "med": 8, "low": 3}


def common_words(texts: DataFrame, most: int = 12) -> DataFrame:
    """(word, n, rank): the words of a job description that come twice or more, the commonest first, of equals the first to come. A top-k report."""
    words = texts.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z+#.-]{3,}"), F.lit(0))).alias("at", "w"))
    words = words.withColumn("word", F.regexp_replace("w", r"[.-]+$", "")).where(~F.col("word").isin(STOP))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("item_id", "at")).alias("first")).where("n >= 2")
    top = counts.orderBy(F.desc("n"), "first").limit(most)
    return top.select("word", "n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "first")).cast("long").alias("rank"))


def keywords_found(low: Column, words: list[str]) -> Column:
    """How many of the words stand in a text in lower case, bounded by other characters than letters and digits. A plain search rules most out before the expression runs."""
    return sum(((low.contains(w) & low.rlike(r"(^|[^a-z0-9])\Q" + w + r"\E($|[^a-z0-9])")).cast("long") for w in words), F.lit(0).cast("long"))


def risk_flags(text: Column) -> dict[str, Column]:
    """The checker's rules that a text alone decides."""
    email = text.contains("@") & text.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+")
    number = F.regexp_extract(F.regexp_replace(text, r"[0-9]{1,2}/[0-9]{4}", ""), r"(\+?[0-9][0-9 \t\n().-]{8,}[0-9])", 1)
    phone = text.rlike("[0-9]") & (F.length(F.regexp_replace(number, "[^0-9]", "")) >= 10)
    dates = (text.contains("19") | text.contains("20")) & text.rlike(r"(?<![0-9A-Za-z_])(?:19|20)[0-9]{2}[ ]*[-–—][ ]*(?:(?:19|20)[0-9]{2}|present|current|now)(?![0-9A-Za-z_])")
    glyphs = text.rlike(r"[\x{E000}-\x{F8FF}\x{FFFD}\x{2190}-\x{21FF}\x{25A0}-\x{25CE}\x{2700}-\x{27BF}]|\(cid:[0-9]+\)")
    return {"notext": ~text.rlike(r"^\s*+(?:\S\s*+){80}"), "contact": ~email | ~phone, "dates": dates, "glyphs": glyphs}


LEVELS = (("notext", "high"), ("contact", "high"), ("dates", "med"), ("glyphs", "med"))


def checked_texts(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(doc_id, the flags, parse and, for words, found, kw_score and score) of docs (doc_id, text), all from one scan."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    if words is not None:
        read = read.withColumn("low", F.lower("t"))
    flags = risk_flags(F.col("t"))
    found = [] if words is None else [keywords_found(F.col("low"), words).alias("found")]
    out = read.select("doc_id", *[flags[f].alias(f) for f, _ in LEVELS], *found)
    out = out.withColumn("parse", F.greatest(F.lit(0), 100 - sum((F.col(f).cast("long") * PENALTY[level] for f, level in LEVELS), F.lit(0))).cast("long"))
    if words is None:
        return out
    out = out.withColumn("kw_score", js_round(100.0 * F.col("found") / len(words)) if words else F.lit(100).cast("long"))
    return out.withColumn("score", js_round(0.6 * F.col("kw_score") + 0.4 * F.col("parse")))


def keyword_match(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, found, kw_score): how many of the keywords stand in the text, and their share."""
    found = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).select("doc_id", keywords_found(F.col("low"), words).alias("found"))
    return found.withColumn("kw_score", js_round(100.0 * F.col("found") / len(words)) if words else F.lit(100).cast("long"))


def parser_risks(docs: DataFrame) -> DataFrame:
    """(doc_id, notext, contact, dates, glyphs, parse): the checker's rules that a text alone decides, and 100 minus their penalties. checker.py has all twelve."""
    return checked_texts(docs)


def sections(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """rows (by, line_no, text) with the section each line is in: that of the last heading at or before it, null before the first."""
    upto = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    headed = rows.withColumn("_h", heading(F.col("text")))
    return headed.select("*", F.col("_h").isNotNull().alias("is_heading"), F.last("_h", True).over(upto).alias("section")).drop("_h")


def bullet_items(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, item, text): the items of a list of lines (by, line_no, text, gap to the line before, size).

    A lone mark makes the next line an item. A line after an item stays in it while no line in between does otherwise: it
    follows closely and starts in lower case, or the line before doesn't end a sentence. Others without a mark join
    the line before if that is no sentence's end and they start in lower case. All is told by windows over the lines.
    """
    every = Window.partitionBy(by).orderBy("line_no")
    lone = F.col("text").rlike(LONE_BULLET)
    marked = lines.withColumn("lone", lone).withColumn("pending", F.coalesce(F.lag("lone").over(every), F.lit(False))).where(~F.col("lone"))
    before = F.btrim(F.lag("text").over(every))
    marked = marked.withColumn("glyph", F.col("pending") | F.col("text").rlike(BULLET)).withColumn("bare", clean(F.regexp_replace("text", BULLET, "")))
    follows = (F.col("gap") < 2 * F.col("size")) & (F.btrim("text").rlike("^[a-z(]") | ~F.coalesce(before, F.lit("")).rlike("[.;!?]$"))
    marked = marked.withColumn("follows", ~F.col("glyph") & follows).withColumn("run", F.sum(F.col("glyph").cast("int")).over(every))
    inside = Window.partitionBy(by, "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("cont", (F.col("run") > 0) & ~F.col("glyph") & (F.min(F.col("follows") | F.col("glyph")).over(inside))).where("bare <> ''")
    last = F.lag("bare").over(every)
    joins = ~F.col("glyph") & last.isNotNull() & (F.col("cont") | ~last.rlike("[.!?]$") & (F.col("gap") < 1.6 * F.col("size")) & F.col("bare").rlike("^[a-z(0-9]"))
    told = marked.withColumn("starts", (~joins).cast("int")).withColumn("item", F.sum("starts").over(every) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "bare"))), lambda p: p["bare"])
    return told.groupBy(by, "item").agg(F.array_join(ordered, " ").alias("text"))
