"""Jobs, schools and projects: the lines of a résumé's section told apart into entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.resume_text import BULLET, LONE_BULLET, date_range, is_header, tidy
from pagewright.functions.scalars import running, split_title

# Words of job titles, of companies, and the confidences of an entry.
TITLE = (
    r"(?i)(?<![0-9A-Za-z_])(engineer|developer|manager|analyst|intern|designer|consultant|lead|associate|specialist|architect|scientist|officer|executive|director|head|trainee|administrator|tester|programmer|"
    r"accountant|teacher|professor|researcher|founder|co-founder|vp|president)(?![0-9A-Za-z_])"
)
COMPANY = r"(?i)(?<![0-9A-Za-z_])(pvt|ltd|inc|llc|technologies|solutions|limited|corp|company|labs|university)(?![0-9A-Za-z_])"
FIRM = r"(?i)(?<![0-9A-Za-z_])(pvt|ltd|inc|llc|technologies|solutions|limited|corp)(?![0-9A-Za-z_])"
SURE, LIKELY, DOUBTFUL = 0.85, 0.65, 0.45
YEAR = r"(?<![0-9A-Za-z_])(?:19|20)[0-9]{2}(?![0-9A-Za-z_])"


def marked(lines: DataFrame, by: str = "doc") -> DataFrame:
    """lines (by, at, text, bold, bullet, gap, size) without lone marks, with `item` (it has a mark, or a lone one before it) and `cont` (it goes on in an item), dates (the first range, or null).

    A line goes on in an item as long as all lines since its mark do: not bold, without a range of dates, close to the
    line before, and in lower case or after a line that ends no sentence. All is told by windows.
    """
    every = Window.partitionBy(by).orderBy("at")
    kept = lines.withColumn("lone", F.col("text").rlike(LONE_BULLET)).withColumn("pending", F.coalesce(F.lag("lone").over(every), F.lit(False))).where(~F.col("lone"))
    kept = kept.withColumn("item", F.col("bullet") | F.col("pending") | F.col("text").rlike(BULLET))
    kept = kept.withColumn("text", F.when(F.col("pending"), F.concat(F.lit("• "), F.regexp_replace("text", BULLET, ""))).otherwise(F.col("text"))).withColumn("dates", date_range(F.col("text")))
    before = F.btrim(F.coalesce(F.lag("text").over(every), F.lit("")))
    follows = ~F.col("bold") & ~F.coalesce(~F.col("dates.single"), F.lit(False)) & (F.col("gap") < 2 * F.col("size")) & (F.btrim("text").rlike("^[a-z(]") | ~before.rlike("[.;!?]$"))
    kept = kept.withColumn("goes", F.col("item") | follows).withColumn("run", F.sum(F.col("item").cast("int")).over(every))
    inside = Window.partitionBy(by, "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cont = (F.col("run") > 0) & ~F.col("item") & F.min("goes").over(inside)
    return kept.withColumn("cont", cont).drop("lone", "pending", "goes", "run")


def step(s: Column, x: Column) -> Column:
    """The state after one more line: what the open entry has, which entry it is, and whether the line gave its dates."""
    school = x["school"] & ~((s["n"] == 1) & ~s["first_year"])
    name = x["name"] & ((s["n"] == 0) | s["dated"])
    waits = (s["opener"] | (s["n"] == 1) & s["alone"]) & ~s["dated"] & (s["n"] <= 2)  # a header completes an entry that waits for its dates
    starts = (s["n"] == 0) | x["title"] | x["project"] | name | school & s["year"] | x["header"] & ~waits
    gives = F.when(starts, x["header"] | school & x["dates"]).otherwise(x["header"] & ~s["dated"])
    new = lambda a, b: F.when(starts, a).otherwise(b)
    return F.struct(
        (s["entry"] + starts.cast("int")).alias("entry"), new(F.lit(1), F.least(F.lit(3), s["n"] + 1)).alias("n"), new(gives, s["dated"] | gives).alias("dated"), new(x["title"] | name, s["opener"]).alias("opener"),
        new(x["year"], s["year"] | x["year"]).alias("year"), new(x["year"], s["first_year"]).alias("first_year"), new(x["alone"], s["alone"]).alias("alone"), gives.alias("gives"),
    )


def entry_lines(lines: DataFrame, kind: str = "work", by: str = "doc") -> DataFrame:
    """The lines of sections (by, at, text, bold, bullet, gap, size) with entry, from 0, opens, gives (the line whose dates the entry has), head (it belongs to the entry's title), dates; lone marks are left out.

    kind: work, education or projects. An entry opens with a line that holds dates and a few words, or a title or name
    right before such a line; a school's with a year; a project's with a bold or short title before its description. What
    a line does hangs on the next two lines and on a bounded state (how many lines the open entry has, whether it is
    dated): windows look ahead, and the states of a section fold over one array of flags in the JVM, without Python.
    Null texts are empty. An empty section has no entries.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    lines = lines.withColumns({"text": F.coalesce("text", F.lit("")), "bold": flag(F.col("bold")), "bullet": flag(F.col("bullet"))})
    rows = marked(lines, by).withColumn("header", is_header(F.col("text"), F.col("item") | F.col("cont")))
    every = Window.partitionBy(by).orderBy("at")
    ahead = lambda c, n=1: flag(F.lead(c, n).over(every))
    bare, length = F.btrim("text"), F.length("text")
    free = ~F.col("item") & ~F.col("cont")
    year = F.col("text").rlike(YEAR)
    dated = F.col("dates").isNotNull()
    title = free & ~dated & (length < 80) & (F.col("bold") | F.col("text").rlike(TITLE)) & (ahead("header") | ahead("header", 2) & ~ahead("item"))
    more = F.lead("at").over(every).isNotNull()
    before = F.btrim(F.lag("text").over(every))
    short = flag(before.rlike("[.!?]$")) & (length < 70)
    project = free & more & ~ahead("bold") & (length < 90) & ~bare.rlike("[.,;:]$") & (F.col("bold") | short) if kind == "projects" else F.lit(False)
    name = ~title & free & ~dated & ahead("header") & (length < 90) & bare.rlike("^[A-Z0-9]") & ~bare.rlike("[.,;:!?]$") if kind != "projects" else F.lit(False)
    school = free & year & (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 6) if kind == "education" else F.lit(False)
    alone = ~F.col("item") & (length < 90) if kind == "work" else F.lit(False)
    flags = {"title": title, "project": project, "name": name, "school": school, "header": F.col("header"), "year": year, "alone": alone, "dates": dated}
    rows = rows.withColumn("x", F.struct(*[flag(c).alias(n) for n, c in flags.items()]))
    line = F.struct("at", "x", *[c for c in ("text", "bold", "bullet", "item", "cont", "dates")])
    of = rows.groupBy(by).agg(F.array_sort(F.collect_list(line), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("lines"))
    no = F.lit(False)
    start = F.struct(F.lit(-1).alias("entry"), F.lit(0).alias("n"), *[no.alias(c) for c in ("dated", "opener", "year", "first_year", "alone", "gives")])
    states = running(F.transform("lines", lambda x: x["x"]), start, step)
    out = of.select(by, F.explode(F.arrays_zip(F.col("lines"), states.alias("s"))).alias("z")).select(by, "z.lines.*", F.col("z.s.entry").alias("entry"), F.col("z.s.gives").alias("gives")).drop("x")
    within = Window.partitionBy(by, "entry").orderBy("at")
    first = F.row_number().over(within)
    plain = ~(F.col("item") | F.col("cont") | F.col("bullet") | F.col("text").rlike(BULLET))
    brief = F.col("bold") | F.col("dates").isNotNull() | (F.length("text") < 45) & ~F.btrim("text").rlike("[.;]$")
    second = plain & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 3) & brief
    out = out.withColumn("_k", first).withColumn("_plain", plain)
    head = (F.col("_k") == 1) & plain | (F.col("_k") == 2) & F.coalesce(F.lag("_plain").over(within), no) & second
    return out.withColumn("opens", F.col("_k") == 1).withColumn("head", head).drop("_k", "_plain")


def without_dates(text: Column, dates: Column) -> Column:
    """A text without the first occurrence of the range, and the zone after an open one."""
    at = F.position(dates["raw"], text)
    rest = F.substring(text, at + F.length(dates["raw"]), F.length(text))
    rest = F.when(dates["present"], F.regexp_replace(rest, r"^\s+[A-Z]{1,3}(?![0-9A-Za-z_])", "")).otherwise(rest)
    return F.when(dates.isNotNull() & (at > 0), F.concat(F.left(text, at - 1), F.lit(" "), rest)).otherwise(text)


def entry_titles(told: DataFrame, by: str = "doc") -> DataFrame:
    """(by, entry, position, name, start, end, n_lines, confidence) of entry_lines of kind work or projects.

    The two title lines, without the dates, are the position and the name; the title's words and those of companies turn
    them round. One title line is split. The confidence says whether position, name and dates are there.
    """
    dates = F.max(F.when(F.col("gives"), F.struct("at", "dates"))).alias("g")
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("head"), F.struct("at", "text")))), lambda h: h["text"])
    of = told.groupBy(by, "entry").agg(dates, heads.alias("h"), F.count("*").alias("n_lines")).withColumn("dates", F.col("g.dates"))
    of = of.withColumn("h", F.filter(F.transform("h", lambda t: tidy(without_dates(t, F.col("dates")))), lambda t: t != ""))
    one = split_title(F.coalesce(F.get("h", F.lit(0)), F.lit("")))
    of = of.withColumn("a", F.when(F.size("h") >= 2, F.get("h", F.lit(0))).otherwise(one["title"])).withColumn("b", F.when(F.size("h") >= 2, F.get("h", F.lit(1))).otherwise(one["place"]))
    swap = lambda c: (F.when(c, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b"))).alias("ab")
    for turned in ((F.size("h") >= 2) & F.col("b").rlike(TITLE) & ~F.col("a").rlike(TITLE), (F.size("h") >= 2) & F.col("a").rlike(COMPANY) & ~F.col("b").rlike(FIRM)):
        of = of.select(by, "entry", "h", "dates", "n_lines", swap(F.coalesce(turned, F.lit(False)))).select(by, "entry", "h", "dates", "n_lines", "ab.a", "ab.b")
    name = F.regexp_replace(F.coalesce("b", F.lit("")), r"\s{2,}.*$", "")
    of = of.select(by, "entry", tidy(F.coalesce("a", F.lit(""))).alias("position"), tidy(name).alias("name"), F.coalesce("dates.start", F.lit("")).alias("start"), F.coalesce("dates.end", F.lit("")).alias("end"), "n_lines", F.col("dates").isNotNull().alias("_d"))
    there = F.col("position") != ""
    sure = F.when(there & (F.col("name") != "") & F.col("_d"), SURE).when(there & ((F.col("name") != "") | F.col("_d")), LIKELY).otherwise(DOUBTFUL)
    return of.withColumn("confidence", sure).drop("_d")
