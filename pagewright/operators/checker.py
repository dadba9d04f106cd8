"""The parser check of a document: its lines as a plain parser reads them, twelve risks, keywords and a score."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from string import ascii_uppercase as UPPER

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import js_round, let
from pagewright.operators.resume import common_words

# Levels of risks and their penalties, headings and words that tell them, months, symbols, places and keywords of the check.
PENALTY = {"high": 18, "med": 8, "low": 3}
RISKS = ("notext", "images", "columns", "tables", "icons", "contact", "header", "headings", "sections", "dates", "pages", "glyphs")
STANDARD = {
    "summary": r"^(professional\s+)?summary$", "experience": r"^(work\s+|professional\s+)?experience$", "education": "^education$",
    "skills": r"^(technical\s+)?skills$", "certifications": "^certifications?$",
}
ALSO_STANDARD = "^(projects|languages|awards|interests|publications|achievements|volunteering|references)$"
HEADING_WORD = (
    "summary|profile|objective|about|career|experience|employment|history|education|academic|qualification|skill|competenc|expertise|technolog|tools|strength|certific|licen|training|course|achievement|"
    "project|award|honou?r|accomplish|personal|declaration|hobbies|interest|internship|links|social|contact|extra"
)
GUESSES = [
    ("summary", "summary|profile|objective|about"), ("experience", "experience|employment|work history|career"), ("education", "education|academic|qualification"),
    ("skills", "skill|competenc|expertise|technolog|tools"), ("certifications", "certific|licen|training|course"),
]
MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
SYMBOLS = r"[\x{E000}-\x{F8FF}\x{FFFD}\x{2190}-\x{21FF}\x{25A0}-\x{25CE}\x{25D0}-\x{25FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F300}-\x{1FAFF}\x{0}-\x{8}]|\(cid:[0-9]+\)"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
ICON_FONT = "awesome|icon|symbol|dingbat|wingding|material|glyph|zapf|marvosym|academicons"
PLACE = (
    "india|usa|united states|uk|united kingdom|canada|germany|singapore|uae|dubai|australia|remote|mumbai|navi mumbai|thane|pune|delhi|new delhi|noida|gurgaon|gurugram|bangalore|bengaluru|hyderabad|"
    "chennai|kolkata|ahmedabad|jaipur|indore|lucknow|chandigarh|kochi|london|new york|san francisco|seattle|toronto|berlin|maharashtra|karnataka"
)
KEYWORDS = ["Python", "REST APIs", "LLMs", "GenAI", "agents", "orchestration", "evals", "RAG", "observability", "MCP", "LangGraph", "SQL", "UiPath"]
ALIASES = {
    "rest apis": r"\brest(ful)?\s*(apis?|services?|endpoints?)\b|\brest\b", "llms": r"\bllms?\b|large language models?", "genai": r"\bgen[\s-]?ai\b|generative\s+ai", "agents": r"\b(ai\s+)?agent(s|ic)?\b",
    "orchestration": r"\borchestrat(ion|or|ing|e)\b", "evals": r"\bevals?\b|\bevaluations?\b", "rag": r"\brag\b|retrieval[\s-]augmented", "mcp": r"\bmcp\b|model context protocol",
    "sql": r"\b(my|postgre|ms|no|t-|pl/)?sql\b", "uipath": r"\bui\s?path\b",
}
#: What every hit of an alias has one of, in lower case.
STEMS = {
    "rest apis": ["rest"], "llms": ["llm", "large language model"], "genai": ["gen"], "agents": ["agent"], "orchestration": ["orchestrat"], "evals": ["eval"], "rag": ["rag", "retrieval"],
    "mcp": ["mcp", "model context protocol"], "sql": ["sql"], "uipath": ["path"],
}
NOT_TOKENS = "^(I|A|THE|AND|OR|WE|US|YOU)$"
MOST_KEYWORDS, MOST_WORDS, MOST_EXAMPLES = 30, 12, 4
TOKENS = r"\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b|\b[A-Za-z]+\.(?:js|ts|py|net)\b|\b[A-Z]{2,6}s?\b|\b[A-Za-z]+\+\+|C#"
EMAIL = r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(\.[0-9A-Za-z_-]+)+"
PHONE = r"\+?[0-9][0-9\s().-]{8,}[0-9]"
BAD_DATES = [
    rf"\b({MONTH})[a-z]*\.?\s*['’]\s?[0-9]{{2}}\b", r"\b[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{2,4}\b", r"\b(?<![/0-9A-Za-z_])(19|20)[0-9]{2}\s*[-–—]\s*((19|20)[0-9]{2}|present|current|now)\b",
    r"\b[0-9]{4}-[0-9]{2}\b", rf"\b[0-9]{{1,2}}(st|nd|rd|th)\s+({MONTH})",
]
GOOD_DATE = rf"({MONTH})[a-z]*\.?\s+[0-9]{{4}}\s*[-–—]|[0-9]{{1,2}}/[0-9]{{4}}\s*[-–—]"
FULL_DATE = r"['’]\s?[0-9]{2}\b|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
#: Java's \b knows the letters of all scripts, the check's only ASCII.
BOUND = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_bounds(pattern: str) -> str:
    return pattern.replace(r"\b", BOUND)


def keyword_pattern(keyword: str) -> str:
    """The expression of a keyword: its alias, or its letters between others than letters and digits."""
    alias = ALIASES.get(keyword.lower())
    if alias is None:
        return r"(?i)(^|[^a-z0-9])" + r"\s*".join(rf"\Q{part}\E" for part in keyword.split()) + "($|[^a-z0-9])"
    return "(?i)" + ascii_bounds(alias)


def keyword_hit(text: Column, low: Column, keyword: str) -> Column:
    """Whether text, whose lower case is low, has the keyword. What every hit holds, an alias's stem or the keyword's parts, is looked for first, which is much faster."""
    stems = STEMS.get(keyword.lower())
    first = reduce(or_, map(low.contains, stems)) if stems else reduce(and_, [low.contains(p.lower()) for p in keyword.split() if p.isascii()], F.lit(True))
    return first & text.rlike(keyword_pattern(keyword))


def job_keywords(jobs: DataFrame, known: list[str] = KEYWORDS) -> DataFrame:
    """(keyword, rank) of job descriptions (item_id, text): known ones that occur, then names in capitals or with a language's mark, then the commonest other words; the first spelling of each, MOST_KEYWORDS at most. A top-k report."""
    text = F.coalesce("text", F.lit(""))
    hit = F.array(*[F.when(text.rlike(keyword_pattern(k)), F.struct(F.lit(0).alias("kind"), F.lit(i).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(k).alias("k"))) for i, k in enumerate(known)])
    fixed = jobs.select(F.explode(F.array_compact(hit)).alias("o")).select("o.*")
    tokens = jobs.select("item_id", F.posexplode(F.regexp_extract_all(text, F.lit(ascii_bounds(TOKENS)), F.lit(0))).alias("b", "t")).where(~F.col("t").rlike(NOT_TOKENS))
    named = F.when(F.col("t").rlike("[A-Z]{2,}s$"), F.regexp_replace("t", "s$", "")).otherwise(F.col("t"))
    tokens = tokens.select(F.lit(1).alias("kind"), F.col("item_id").cast("long").alias("a"), "b", named.alias("k"))
    words = common_words(jobs, MOST_WORDS).select(F.lit(2).alias("kind"), F.col("rank").alias("a"), F.lit(0).alias("b"), F.col("word").alias("k"))
    every = fixed.union(tokens).union(words).select(F.struct("kind", "a", "b").alias("o"), "k")
    first = every.groupBy(F.lower("k").alias("key")).agg(F.min("o").alias("o"), F.min_by("k", "o").alias("keyword")).orderBy("o").limit(MOST_KEYWORDS)
    return first.select("keyword", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o")).cast("long").alias("rank"))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def parser_lines(items: DataFrame) -> DataFrame:
    """(doc, page, line, top, text, chars, segs, fonts) of items (doc, page, line, seq, s, x, w, top, h, font): segs (x, s) are parted where a gap is wide; pieces of one are joined with a space where a gap is small.

    Where the items of a document are dealt to one task (dealt_texts), they are told where they are.
    """
    line = Window.partitionBy("doc", "page", "line").orderBy("x", "seq")
    gap = F.col("x") - F.max(F.col("x") + F.col("w")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    placed = items.where(trim(F.col("s")) != "").withColumn("gap", gap)
    placed = placed.withColumn("new", F.col("gap").isNull() | (F.col("gap") > F.greatest(F.lit(6.0), F.col("h") * 0.8))).withColumn("seg", F.sum(F.col("new").cast("int")).over(line))
    piece = F.concat(F.when(~F.col("new") & (F.col("gap") > F.col("h") * 0.15), " ").otherwise(""), trim(F.col("s")))
    told = placed.groupBy("doc", "page", "line").agg(F.min("top").alias("top"), F.sum(F.length(trim(F.col("s")))).alias("chars"), F.sort_array(F.collect_list(F.struct("x", "seq", "seg", piece.alias("p"), "font"))).alias("i"))
    numbers = F.sequence(F.lit(1), F.element_at("i", -1)["seg"])

    def segment(n: Column) -> Column:
        own = F.filter("i", lambda p: p["seg"] == n)
        return F.struct(F.get(own, F.lit(0))["x"].alias("x"), F.array_join(F.transform(own, lambda p: p["p"]), "").alias("s"))

    told = told.select("doc", "page", "line", "top", "chars", F.transform(numbers, segment).alias("segs"), F.array_join(F.transform("i", lambda p: p["font"]), " ").alias("fonts"))
    return told.withColumn("text", F.regexp_replace(F.array_join(F.transform("segs", lambda s: s["s"]), "   "), r"\s{4,}", "   "))


def headings(segs: Column) -> Column:
    """The headings among the segments of a line: (key, odd, text); key of a standard one or of the one that odd capitals stand for, odd if it isn't standard."""

    # what is long is left out before anything is upper-cased, which takes most of the time on long texts; a name is told once
    short = F.filter(F.transform(segs, lambda seg: trim(seg["s"])), lambda t: F.length(t) <= 40)
    caps = lambda t: t == F.upper(t)
    found = F.filter(short, lambda t: ~t.rlike("[0-9@:|•]") & (F.size(F.split(t, r"\s+")) <= 5) & F.lower(t).rlike(HEADING_WORD) & ((F.size(segs) == 1) | t.rlike("[A-Z]{3}") & caps(t)))

    def one(t: Column) -> Column:
        return let(F.struct(t.alias("t"), F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", " "), "[&/].*$", "")).alias("n"), caps(t).alias("caps")), named)

    def named(v: Column) -> Column:
        standard = guess = F.lit(None).cast("string")
        for key, pattern in reversed(STANDARD.items()):
            standard = F.when(v["n"].rlike(pattern), key).otherwise(standard)
        for key, pattern in reversed(GUESSES):
            guess = F.when(v["n"].rlike(pattern), key).otherwise(guess)
        odd = standard.isNull() & ~v["n"].rlike(ALSO_STANDARD) & v["caps"]
        return F.when(standard.isNotNull() | odd, F.struct(F.coalesce(standard, guess).alias("key"), odd.alias("odd"), v["t"].alias("text")))

    return F.filter(F.transform(found, one), lambda h: h.isNotNull())


def checked_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with what each tells: email, place (one of the first 25), edge (contact in a margin), icon, date, symbol, grid (shares its segments' starts with the line before), heads."""
    text, digits = F.col("text"), r"[0-9]{5,}|[0-9]{3}[\s-][0-9]{3}"
    in_doc, in_page = Window.partitionBy("doc").orderBy("page", "line"), Window.partitionBy("doc", "page").orderBy("line")
    before = F.lag("segs").over(in_page)
    shared = F.filter("segs", lambda s: F.exists(before, lambda q: F.abs(q["x"] - s["x"]) < 5))
    grid = F.coalesce((F.size("segs") >= 2) & (F.size(before) >= 2) & (F.size(shared) >= 2), F.lit(False))
    # most lines have neither digits nor @, which is told much faster
    bad = text.rlike("[0-9]") & text.rlike(ascii_bounds("(?i)" + "|".join(BAD_DATES))) & ~(text.rlike("(?i)" + GOOD_DATE) & ~text.rlike(ascii_bounds(FULL_DATE)))
    out = lines.join(pages.select("doc", "page", "h"), ["doc", "page"])
    return out.select(
        "doc", "page", "line", "text", "chars", "segs", (text.contains("@") & text.rlike(EMAIL)).alias("email"), ((F.row_number().over(in_doc) <= 25) & text.rlike(ascii_bounds(rf"(?i)\b({PLACE})\b|,\s*[A-Z]{{2}}\b"))).alias("place"),
        (((F.col("top") < F.col("h") * 0.05) | (F.col("top") > F.col("h") * 0.95)) & (text.contains("@") | text.rlike(digits))).alias("edge"), (text.rlike(PRIVATE) | F.col("fonts").rlike("(?i)" + ICON_FONT)).alias("icon"),
        bad.alias("date"), text.rlike(SYMBOLS).alias("symbol"), grid.alias("grid"), headings(F.col("segs")).alias("heads"),
    ).withColumn("table", F.col("grid") & F.coalesce(F.lag("grid").over(in_page), F.lit(False)))


def checked_pages(checked: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, column, empty, big, small) of pages (doc, page, w, h, big, small): whether many later segments of its lines start at one place, and whether it has under 40 characters."""
    starts = F.flatten(F.collect_list(F.transform(F.slice("segs", F.lit(2), F.greatest(F.lit(0), F.size("segs") - 1)), lambda s: s["x"])))
    told = checked.groupBy("doc", "page").agg(starts.alias("xs"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    told = pages.join(told, ["doc", "page"], "left")
    buckets = F.transform(F.filter("xs", lambda x: (x > F.col("w") * 0.28) & (x < F.col("w") * 0.8)), lambda x: js_round(x / 6))
    told = told.withColumn("b", F.coalesce(buckets, F.array().cast("array<bigint>")))
    most = F.array_max(F.transform(F.array_distinct("b"), lambda k: F.size(F.filter("b", lambda v: F.abs(v - k) <= 1))))
    return told.select("doc", "page", (F.coalesce(most, F.lit(0)) >= F.greatest(F.lit(5.0), F.coalesce("n", F.lit(0)) * 0.15)).alias("column"), (F.coalesce("chars", F.lit(0)) < 40).alias("empty"), "big", "small")


def risks(checked: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, text, the level of each of RISKS, null where it doesn't arise): one row for each document of pages."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = F.array_compact(F.array_distinct(F.flatten(F.collect_list(F.transform("heads", lambda h: h["key"])))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda l: l["text"])  # noqa: E741
    by_line = checked.groupBy("doc").agg(
        F.array_join(ordered, "\n").alias("text"), *[some(c).alias(c) for c in ("email", "place", "edge", "icon", "date", "symbol", "table")], some(F.exists("heads", lambda h: h["odd"])).alias("odd"), seen.alias("seen"),
    )
    by_page = checked_pages(checked, pages).groupBy("doc").agg(F.count("*").alias("n"), some("column").alias("column"), some("empty").alias("empty"), F.sum("big").alias("big"), F.sum("small").alias("small"))
    d = by_page.join(by_line, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("chars", F.length(F.regexp_replace("text", r"\s", ""))).withColumn("digits", F.regexp_replace(F.regexp_extract(F.regexp_replace("text", "[0-9]{1,2}/[0-9]{4}", ""), PHONE, 0), "[^0-9]", ""))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    absent = F.filter(F.array(*map(F.lit, STANDARD)), lambda k: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), k))
    level = {
        "notext": F.when((F.col("chars") < 80) | F.col("empty"), "high"), "images": F.when((F.col("big") > 0) & (F.col("chars") >= 80), "med"), "columns": F.when(F.col("column"), "high"), "tables": F.when(is_("table"), "med"),
        "icons": F.when(is_("icon") | (F.col("small") >= 2), "med"), "contact": F.when(~is_("email") | (F.length("digits") < 10), "high").when(~is_("place"), "low"), "header": F.when(is_("edge"), "med"),
        "headings": F.when(is_("odd"), "med"), "sections": F.when(F.arrays_overlap(absent, F.array(F.lit("experience"), F.lit("education"))), "med").when(F.size(absent) > 0, "low"),
        "dates": F.when(is_("date"), "med"), "pages": F.when(F.col("n") > 2, "low"), "glyphs": F.when(is_("symbol"), "med"),
    }
    return d.select("doc", "text", *[level[r].alias(r) for r in RISKS])


def analyzed(found: DataFrame, keywords: list[str]) -> DataFrame:
    """(doc, levels, n_risks, parse, found, kw_score, score) of risks(): 100 less the penalties, the share of the keywords found, and 60 % of it with 40 % of the former."""
    penalty = sum((F.when(F.col(r) == level, p).otherwise(0) for r in RISKS for level, p in PENALTY.items()), F.lit(0))
    hits = sum((keyword_hit(F.col("text"), F.col("_low"), k).cast("long") for k in keywords), F.lit(0).cast("long"))
    n = sum((F.col(r).isNotNull().cast("long") for r in RISKS), F.lit(0).cast("long"))
    found = found.withColumn("_low", F.translate("text", UPPER, UPPER.lower()))
    out = found.select("doc", *RISKS, n.alias("n_risks"), F.greatest(F.lit(0), 100 - penalty).cast("long").alias("parse"), hits.alias("found"))
    out = out.withColumn("kw_score", js_round(100.0 * F.col("found") / len(keywords)) if keywords else F.lit(100).cast("long"))
    return out.withColumn("score", js_round(0.6 * F.col("kw_score") + 0.4 * F.col("parse")))


def plain_symbols(text: Column) -> Column:
    """Text with what isn't ASCII, but for a few marks, told by its code point."""
    code = lambda c: F.concat(F.lit("⟨U+"), F.hex(F.ascii(c).cast("long")), F.lit("⟩"))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when((c == "") | c.rlike("[ -~•–—’]"), c).otherwise(code(c))), "")


def risk_examples(checked: DataFrame) -> DataFrame:
    """(doc, risk, examples): the first lines that show a risk, MOST_EXAMPLES at most, between bars. A top-k report."""
    shown = [("tables", F.when(F.col("grid"), F.array("text"))), ("icons", F.when(F.col("icon"), F.array("text"))), ("header", F.when(F.col("edge"), F.array("text"))), ("dates", F.when(F.col("date"), F.array("text"))), ("glyphs", F.when(F.col("symbol"), F.array(plain_symbols(F.col("text"))))), ("headings", F.transform(F.filter("heads", lambda h: h["odd"]), lambda h: F.concat(h["text"], F.when(h["key"].isNotNull(), F.concat(F.lit(" → use “"), F.initcap(h["key"]), F.lit("”"))).otherwise(F.lit("")))))]

    def named(risk: str, texts: Column) -> Column:
        return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(risk).alias("risk"), i.alias("i"), t.alias("text")))

    each = F.flatten(F.array(*[named(*x) for x in shown]))
    rows = checked.select("doc", "page", "line", F.explode(each).alias("e")).select("doc", "page", "line", "e.*")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc", "risk").orderBy("page", "line", "i"))).where(F.col("n") <= MOST_EXAMPLES)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda e: e["text"])
    return first.groupBy("doc", "risk").agg(F.array_join(ordered, " | ").alias("examples"))
