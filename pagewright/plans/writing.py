"""The queries of the résumé text functions. Rows take written cases in turn; the SQL holds what each case means, told by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import resume_text, scalars
from pagewright.operators import resume
from pagewright.plans.catalog import LINES, dealt, doc_lines, longs, read
from pagewright.plans.checker import quoted

HEADINGS = {
    "Work Experience": "work", "E X P E R I E N C E": "work", "S U M M A RY": "summary", "W O R K E X P E R I E N C E": "work", "Education:": "education", "2. SKILLS & ABILITIES": "skills", "Skills and Tools": None,
    "Experience / अनुभव": "work", "अनुभव / Experience": "work", "Honors & Awards (selected)": "awards", "HOBBIES_": "interests", "Professional  Summary.": "summary", "Languages Known —": "languages", "por": "awards", "My summary of things": None,
    "Declaration": "declaration", "Personal Details :": "personal", "Publications|Talks": "other", "": None, "no heading at all": None,
}
RANGES = {
    "Jan 2020 - Mar 2021": ("2020-01", "2021-03", "Jan 2020 - Mar 2021", False, False), "Acme, 2019 – Present": ("2019", "", "2019 – Present", True, False), "2019-23 at college": ("2019", "2023", "2019-23", False, False),
    "03/2018 to 11/2020, Pune": ("2018-03", "2020-11", "03/2018 to 11/2020", False, False), "Sept. '09 — till date": ("2009-09", "", "Sept. '09 — till date", True, False), "2021 – वर्तमान में": ("2021", "", "2021 – वर्तमान", True, False),
    "2021 – दिल्ली": ("", "2021", "2021", False, True), "2016 – 2018 दिल्ली": ("2016", "2018", "2016 – 2018", False, False), "Class of 2014": ("", "2014", "2014", False, True), "May 5": None, "none": None, "": None,
    "Dec 99 until now": ("1999-12", "", "Dec 99 until now", True, False), "2021 – वत मान": ("2021", "", "2021 – वत मान", True, False),
}
TIDIED = {
    "A • • OP": "A · OP", "Acme ( ) , Pune": "Acme, Pune", "• , Role —": "Role", "[ - ] x  y ;z": "x y;z", "a - | b": "a · b", "plain": "plain", "": "", "– (–) –": "", "one · two": "one · two",
}
PHONES = {
    "call 98765 43210 now": ("98765 43210", 0.95), "+91-9876543210": ("+91-9876543210", 0.95), "(030) 1234 5678": ("(030) 1234 5678", 0.7), "+44) 20 7946 0958": ("+44 20 7946 0958", 0.7), "2019 - 2021 2022": None, "12345": None, "none": None,
}
NAMES = {
    "JOHN  SMITH | Engineer": "John Smith", "SaraDsouza": "Sara Dsouza", "A N N A": "Anna", "Mary Jones (CV)": "Mary Jones", "Ann O'NEIL": "Ann O'NEIL", "ANN O'NEIL-LEE": "Ann O'Neil-Lee", "Jo · Berlin": "Jo",
}
PLACES = {"lives in Pune, Maharashtra now": ("Pune", "Maharashtra"), "San Jose, CA": ("San Jose", "CA"), "Manager, India": None, "Software Engineer, UK": None, "pune, india": None, "New Delhi, NCR · x": ("New Delhi", "NCR")}
LINKS = {
    "see https://www.linkedin.com/in/ann-x/ and github.com/annx": "LinkedIn https://www.linkedin.com/in/ann-x/; GitHub github.com/annx", "B.Tech, Node.js, ann.dev": "ann.dev ann.dev",
    "me@x.com · www.site.io/cv, http://SITE.io/cv": "SITE.io http://SITE.io/cv", "none": "", "m.me/x is a page": "m.me m.me/x", "GitHub.com/A, https://github.com/a/": "GitHub GitHub.com/A",
}
SKILLS = {
    "Languages: Java, C++, java, and Go.": "Java/C++/Go", "• Tally ★★★★ | Excel": "Tally/Excel", "a very long item that can't be one skill at all, SQL": "SQL", "Word   Excel;PowerPoint//Access": "Word Excel/PowerPoint/Access", "": "",
}
HEADERS = {
    "Engineer, Acme 2019 - 2021": True, "2024: did so": False, "2024 built x": False, "Acme 2014": True, "2019 - 2021": False, "no dates here": False, "2014 Acme": False, "Acme (Jan 2020 – Present)": True,
}
#: Lines of lists, which stand in for every document's lines in turn.
LIST = ["•", "First item starts", "and goes on here", "Second part.", "- Another item", "Then Text", "1. Numbered;", "continued after", "Plain line", "plain again"]


def facts(cases: dict, said: str, columns: list[str], told: Callable[[Column], list[Column]]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query that puts the cases, in turn, through functions, and the SQL of what comes out."""
    keys = list(cases)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        case = F.get(F.array(*map(F.lit, keys)), (F.col("p_partkey") % len(keys)).cast("int"))
        rows = dealt(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", case.alias(said))
        return rows.select("p_partkey", said, *[c.alias(n) for n, c in zip(columns, told(F.col(said)), strict=True)])

    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else quoted(v)

    wide = [v if isinstance(v, tuple) else (v,) * len(columns) if v is None else (v,) for v in cases.values()]
    values = ", ".join("(" + ", ".join([str(i), quoted(k), *map(literal, v)]) + ")" for i, (k, v) in enumerate(zip(keys, wide, strict=True)))
    return query, f"SELECT p_partkey, f.* EXCLUDE (i) FROM part JOIN (VALUES {values}) AS f(i, {said}, {', '.join(columns)}) ON p_partkey % {len(keys)} = i"


def fields(c: Column, names: list[str]) -> list[Column]:
    return [c[n] for n in names]


RANGE = ["start", "end", "raw", "present", "single"]
ranges, RANGES_SQL = facts(RANGES, "said", ["a", "b", "raw", "present", "single"], lambda c: fields(resume_text.date_range(c), RANGE))
CASES = {
    "headings": facts(HEADINGS, "said", ["section"], lambda c: [resume_text.heading(c)]),
    "date_ranges": (ranges, RANGES_SQL),
    "tidied": facts(TIDIED, "said", ["tidy"], lambda c: [resume_text.tidy(c)]),
    "phones": facts(PHONES, "said", ["number", "quality"], lambda c: fields(resume_text.phone(c), ["number", "quality"])),
    "person_names": facts(NAMES, "said", ["name"], lambda c: [resume_text.person_name(c)]),
    "locations": facts(PLACES, "said", ["city", "region"], lambda c: fields(resume_text.location(c), ["city", "region"])),
    "links": facts(LINKS, "said", ["found"], lambda c: [F.array_join(F.transform(resume_text.links(c), lambda x: F.concat_ws(" ", x["network"], x["url"])), "; ")]),
    "skill_items": facts(SKILLS, "said", ["items"], lambda c: [F.array_join(resume_text.skills(c), "/")]),
    "header_lines": facts(HEADERS, "said", ["header"], lambda c: [resume_text.is_header(c, F.lit(False))]),
}


def headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines, every ninth one of HEADINGS instead."""
    said = F.get(F.array(*map(F.lit, HEADINGS)), ((F.col("doc_id") + F.col("line_no")) % len(HEADINGS)).cast("int"))
    return doc_lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 9 == 4, said).otherwise(F.col("text")))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(resume.sections(headed_lines(spark, sf_dir)).select("doc_id", "line_no", "is_heading", "section"))


def bullet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).select("doc_id", "line_no", F.get(F.array(*map(F.lit, LIST)), ((F.col("line_no") + F.col("doc_id")) % len(LIST)).cast("int")).alias("text"), F.when(F.col("line_no") % 23 == 0, 40.0).otherwise(14.0).alias("gap"), F.lit(10.0).alias("size"))
    return longs(resume.bullet_items(lines))


QUERIES = {**{k: q for k, (q, _) in CASES.items()}, "sections": sections, "bullet_lists": bullet_lists}
#: The dictionary of headings, and how a plain line is looked up in it: in lower case, from its first letter, without marks at its end.
ENTRIES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in resume_text.ENTRIES.items())
LOOKED_UP = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^[^a-z]+', ''), '[:|–—_•. -]+$', ''), '\s+', ' ', 'g'))"
KNOWN = ", ".join(f"({i}, {quoted(v) if v else 'NULL'})" for i, v in enumerate(HEADINGS.values()))
ORACLE_SQL = {
    **{k: s for k, (_, s) in CASES.items()},
    "sections": f"""WITH {LINES}, known(i, h) AS (VALUES {KNOWN}), entries(e, section) AS (VALUES {ENTRIES}), headed AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 4 THEN h ELSE section END AS h FROM lines LEFT JOIN entries ON e = {LOOKED_UP} LEFT JOIN known ON (doc_id + line_no) % {len(HEADINGS)} = i)
SELECT doc_id, line_no, h IS NOT NULL AS is_heading, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM headed""",
    # a step for each line, with the list item under way
    "bullet_lists": f"""WITH RECURSIVE {LINES}, said AS (SELECT doc_id, line_no, [{', '.join(map(quoted, LIST))}][((line_no + doc_id) % {len(LIST)} + 1)::INT] AS t, CASE WHEN line_no % 23 = 0 THEN 40 ELSE 14 END AS gap FROM lines),
steps AS (SELECT doc_id, -1::BIGINT AS line_no, false AS pending, false AS in_b, '' AS kept, 0::BIGINT AS item, NULL::VARCHAR AS piece FROM documents UNION ALL
  SELECT n.doc_id, n.line_no, lone, CASE WHEN lone THEN in_b ELSE glyph OR cont END, CASE WHEN lone THEN kept ELSE t END, item + CASE WHEN lone OR NOT glyph AND item > 0 AND (cont OR NOT regexp_matches(kept, '[.!?]$') AND gap < 16 AND regexp_matches(bare, '^[a-z(0-9]')) THEN 0 ELSE 1 END, CASE WHEN lone THEN NULL ELSE bare END
  FROM (SELECT s.*, p.pending, p.in_b, p.kept, p.item, s.t = '•' AS lone, p.pending OR regexp_matches(s.t, '^(- |1[.] )') AS glyph, regexp_replace(s.t, '^(- |1[.] )', '') AS bare,
    p.in_b AND NOT (p.pending OR regexp_matches(s.t, '^(- |1[.] )')) AND gap < 20 AND (regexp_matches(s.t, '^[a-z(]') OR NOT regexp_matches(p.kept, '[.;!?]$')) AS cont FROM steps p JOIN said s ON s.doc_id = p.doc_id AND s.line_no = p.line_no + 1) n)
SELECT doc_id, item - 1 AS item, string_agg(piece, ' ' ORDER BY line_no) AS text FROM steps WHERE piece IS NOT NULL GROUP BY doc_id, item""",
}
