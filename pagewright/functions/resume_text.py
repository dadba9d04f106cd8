"""Rules of written résumés as column expressions: headings, date ranges, names, phones, places, links and lists."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.scalars import PRESENT, clean, norm_date

# Headings by section, months, words that read as "present" in Devanagari, bullets, addresses, places and titles.
SECTIONS = {
    "summary": "summary, profile, professional summary, objective, career objective, about me, profile summary, professional profile, career summary, about",
    "work": "experience, work experience, employment history, professional experience, internships, internship, industrial training, employment, work history, relevant experience, experience summary",
    "education": "education, academic qualifications, educational qualification, educational qualifications, scholastic record, academics, academic details, qualifications, academic background, education and training",
    "skills": "skills, technical skills, key skills, core competencies, areas of expertise, it skills, skill set, skills & abilities, skills and abilities, technologies, tools, computer skills, soft skills, strengths, expertise, languages and technologies, programming skills",
    "projects": "projects, academic projects, major project, minor project, personal projects, key projects, project",
    "awards": "certifications, certificates, achievements, awards, honors, honours, honors & awards, awards and achievements, grants and awards, extra-curricular activities, extracurricular activities, extra curricular activities, positions of responsibility, por, activities, accomplishments, leadership, training, courses, trainings",
    "languages": "languages known, languages, language",
    "interests": "hobbies, interests, hobbies and interests, hobbies & interests",
    "other": "references, referees, selected publications, publications, volunteer, volunteering, misc, miscellaneous, additional information, other, research, patents, talks",
    "personal": "personal details, personal information, personal profile, personal data, personal info",
    "declaration": "declaration",
}
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
NOW_WORDS = ["वर्तमान", "वर्तमान तक", "अब तक", "आज तक", "अभी तक", "अद्यतन", "जारी"]
DEVANAGARI_MARKS = r"[\x{0900}-\x{0903}\x{093A}-\x{094F}\x{0951}-\x{0957}\x{0962}\x{0963}\x{200B}-\x{200D}\s]"
BULLET = r"^\s*(?:[•\-–—▪◦●○■□➢➤►▸*·‣⁃✓✔]|\(?[0-9]{1,2}[.)]|[a-z][.)](?=\s))\s*"
LONE_BULLET = r"^\s*[•\-–—▪◦●○■□➢➤►▸*·‣⁃✓✔]\s*$"
EMAIL = r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+"
PHONE_INDIA = r"(?:\+?91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}(?![0-9A-Za-z_])"
PHONE_ANY = r"\+?\(?[0-9][0-9\s().-]{8,}[0-9]"
PROFILES = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[0-9A-Za-z_%-]+/?|(?:https?://)?(?:www\.)?github\.com/[0-9A-Za-z_-]+|https?://[^\s|,·]+"
BARE_LINK = (
    r"(?i)(?<![0-9A-Za-z_@./-])((?:www\.)?[a-z0-9][0-9A-Za-z_-]*(?:\.[0-9A-Za-z_-]+)*\.(?:com|io|in|dev|me|org|net|co|xyz|site|app|ai|tech|page|github\.io|vercel\.app|netlify\.app)(?:/[^\s|,·()]*)?)"
    r"(?=$|[\s|·,)])"
)
DEGREE = r"(?i)^(?:[a-z]{1,2}\.)+(?:tech|sc|com|e|a|arch|des|ed|pharm|ba|ca|phil)\.?$|^[0-9A-Za-z_-]+\.(?:js|ts|py|net)$"
REGION = (
    "India|USA|UK|Canada|Germany|Singapore|UAE|Australia|Maharashtra|Karnataka|Tamil Nadu|Kerala|Telangana|Andhra Pradesh|Gujarat|Rajasthan|Punjab|Haryana|Delhi|Uttar Pradesh|Madhya Pradesh|"
    "West Bengal|Bihar|Odisha|Assam|Goa|Jharkhand|Chhattisgarh|Uttarakhand|Himachal Pradesh|Jammu and Kashmir|NCR|[A-Z]{2}"
)
STARS = "[★☆✩✪●○◉◯◦▪■□]"

ENTRIES = {entry: section for section, entries in SECTIONS.items() for entry in entries.split(", ")}
TIGHT = {}
for _entry, _section in ENTRIES.items():
    TIGHT.setdefault(_entry.replace(" ", ""), _section)
#: A heading holds one of these once its spaces are out: entries that hold no other entry.
STEMS = [t for t in TIGHT if not any(o != t and o in t for o in TIGHT)]
DATE = rf"(?:{MONTH}\s*,?\s*'?[0-9]{{2,4}}|[0-9]{{1,2}}[/.][0-9]{{2,4}}|(?:19|20)[0-9]{{2}})"
DEVANAGARI_RUN = r"[\x{0900}-\x{097F}](?:[\x{0900}-\x{097F}\x{200C}\x{200D}]|\s+(?=[\x{0900}-\x{097F}]))*"
RANGE = rf"(?iu)({DATE})\s*(?:-|‐|‑|−|–|—|to|till|until)\s*({DATE}|present|current|till date|now|ongoing|today|{DEVANAGARI_RUN}|[0-9]{{2}}(?![0-9A-Za-z_]))"
LATIN_RANGE = RANGE.replace("|" + DEVANAGARI_RUN, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def heading(text: Column) -> Column:
    """The section that a heading opens; null for other lines. Letter-spaced, bilingual and numbered ones are read, too."""

    def spaced(s: Column) -> Column:
        words = F.split(s, " ")
        single = F.size(F.filter(words, lambda w: F.length(w) == 1))
        all_single = s.rlike("^(?:[A-Za-z&] ){3,}[A-Za-z&]$")
        most_single = s.rlike("^(?:[A-Za-z&]{1,3} ){3,}[A-Za-z&]{1,3}$") & (single >= 0.6 * F.size(words))
        return F.when(all_single | most_single, lookup(F.lower(F.replace(s, F.lit(" "), F.lit(""))), TIGHT))

    def bare(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.lower(s), r"\s*\([^)]*\)\s*$", ""), r"[:：|\-–—_•.]+$", "")
        return F.btrim(F.regexp_replace(F.regexp_replace(s, "^[^a-z]+", ""), r"\s+", " "))

    def named(b: Column) -> Column:
        return F.coalesce(lookup(b, ENTRIES), lookup(F.replace(b, F.lit("&"), F.lit("and")), ENTRIES))

    def whole(s: Column) -> Column:
        parts = lambda b: F.when(b.rlike("[/|]"), F.get(F.array_compact(F.transform(F.split(b, r"\s*[/|]\s*"), lambda p: let(clean(p), lambda q: F.coalesce(spaced(q), let(bare(q), named))))), F.lit(0)))
        return F.coalesce(spaced(s), let(bare(s), lambda b: F.coalesce(lookup(b, ENTRIES), parts(b), named(b))))

    tight = F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(tight.rlike("|".join(map(re.escape, STEMS)).replace("\\&", "&")), let(clean(text), whole))


def skeleton(text: Column) -> Column:
    """Devanagari without vowel signs, marks and spaces; letters with a dot below as those without."""
    return F.regexp_replace(F.translate(text, "क़ख़ग़ज़ड़ढ़फ़य़", "कखगजडढफय"), DEVANAGARI_MARKS, "")


def _skeletons() -> list[str]:
    marks = re.compile("[ऀ-ःऺ-ॏ॑-ॗॢॣ​-‍\\s]")
    forms = [f for w in NOW_WORDS for f in (w, re.sub("र्(?=[क-ह])", "", w))]
    return sorted({marks.sub("", unicodedata.normalize("NFC", f)) for f in forms})


def present_words(text: Column) -> Column:
    """The leading Devanagari words, four at most, that read as "present"; null if none do. Signs may be missing."""
    words = F.split(F.btrim(text), r"\s+")
    starts = F.transform(F.array(*map(F.lit, (4, 3, 2, 1))), lambda n: F.when(n <= F.size(words), F.array_join(F.slice(words, F.lit(1), n), " ")))
    reads = lambda w: w.isNotNull() & w.rlike(r"^[\x{0900}-\x{097F}\x{200C}\x{200D} ]+$") & skeleton(w).isin(_skeletons())
    return F.when(text.rlike(r"^\s*[\x{0900}-\x{097F}]"), F.get(F.filter(starts, reads), F.lit(0)))


def date_range(text: Column) -> Column:
    """(start, end, raw, present, single): the first range of dates in a text, or else its first single date with a year; null without one."""

    def ranged(raw: Column, pattern: str) -> Column:
        a, b = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
        return let(norm_date(a), lambda start: F.struct(start.alias("start"), norm_date(b, start).alias("end"), raw.alias("raw"), F.lower(b).rlike(PRESENT).alias("present"), F.lit(False).alias("single")))

    def until_now(raw: Column) -> Column:
        said, now = F.regexp_extract(raw, RANGE, 2), present_words(F.regexp_extract(raw, RANGE, 2))
        kept = F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(said)), now)
        return F.when(now.isNotNull(), F.struct(norm_date(F.regexp_extract(raw, RANGE, 1)).alias("start"), F.lit("").alias("end"), kept.alias("raw"), F.lit(True).alias("present"), F.lit(False).alias("single")))

    single = let(F.regexp_extract(text, rf"(?i){DATE}", 0), lambda s: F.when(s.rlike("(?:19|20)[0-9]{2}"), F.struct(F.lit("").alias("start"), norm_date(s).alias("end"), s.alias("raw"), F.lit(False).alias("present"), F.lit(True).alias("single"))))
    latin = let(F.regexp_extract(text, LATIN_RANGE, 0), lambda raw: F.when(raw != "", ranged(raw, LATIN_RANGE)))
    first = let(F.regexp_extract(text, RANGE, 0), lambda raw: F.when(raw == "", F.lit(None)).when(F.regexp_extract(raw, RANGE, 2).rlike(r"^[\x{0900}-\x{097F}]"), F.coalesce(until_now(raw), latin)).otherwise(ranged(raw, RANGE)))
    return F.when(text.rlike("[0-9]"), F.coalesce(first, single))


def tidy(text: Column) -> Column:
    """Text without the empty brackets and separators that are left where dates and places were taken out."""
    out = clean(text)
    for _ in range(4):
        out = F.regexp_replace(out, r"\s*(?:\(\s*[-–—,]?\s*\)|\[\s*[-–—,]?\s*\])", "")
        out = F.regexp_replace(out, r"(?:\s*(?:[•·|–—]|\s-\s)\s*){2,}", " · ")
        out = F.btrim(F.regexp_replace(out, r"^\s*(?:[•·|,–—-]\s*)+|(?:\s*[•·|,–—-])+\s*$", ""))
    return out


def phone(text: Column) -> Column:
    """(number, quality): an Indian mobile of ten digits 0.95, of other lengths 0.6, any other number of 9 to 15 digits 0.7; null without one."""
    india = F.regexp_extract(text, PHONE_INDIA, 0)
    digits = F.regexp_replace(F.regexp_replace(india, "[^0-9]", ""), "^91(?=[0-9]{10}$)", "")
    number = lambda c: F.regexp_replace(c, "[^0-9]", "")
    any_ = F.regexp_extract(text, PHONE_ANY, 0)
    said = F.regexp_replace(F.regexp_replace(clean(any_), r"^(\+?[0-9]{1,3})\)\s*", "$1 "), r"^\((?=[^)]*$)", "")
    good = F.length(number(any_)).between(9, 15) & ~F.btrim(any_).rlike(r"^(19|20)[0-9]{2}\s*[-–]")
    one = F.struct(clean(india).alias("number"), F.when(F.length(digits) == 10, 0.95).otherwise(0.6).alias("quality"))
    return F.when(india != "", one).when(good, F.struct(said.alias("number"), F.lit(0.7).alias("quality")))


def person_name(text: Column) -> Column:
    """A line as a name: what stands before a bar or dash; letter-spaced and joined names parted; capitals only at the start of words where all were."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean(F.regexp_replace(text, r"[\x{0}-\x{1F}\x{FFFD}]", "")), r"\s{2,}.*", ""), r"\s*[|·•,–—].*$", ""), r"(?i)\s*\((?:fictional|cv|resume)\)\s*$", "")
    t = F.when(t.rlike("^(?:[A-Za-z] ){3,}[A-Za-z]$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    t = F.when(t.rlike(r"\s"), t).otherwise(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"))
    titled = F.array_join(F.transform(F.split(F.lower(t), "(?<![0-9a-z_])(?=[a-z])", -1), lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")
    return F.when(t == F.upper(t), titled).otherwise(t)


def location(text: Column) -> Column:
    """(city, region) of the first "City, Region"; null without one or where a job's title stands in the city's place."""
    pattern = rf"(?<![0-9A-Za-z_])([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?),\s*({REGION})(?![0-9A-Za-z_])"
    city = F.regexp_extract(text, pattern, 1)
    return F.when((city != "") & ~F.lower(city).rlike("manager|engineer|developer|designer|analyst"), F.struct(city.alias("city"), F.regexp_extract(text, pattern, 2).alias("region")))


def links(text: Column) -> Column:
    """The addresses of a text, (network, url), each once: full ones first, then bare domains that are no degrees or file names."""
    bare = F.filter(F.regexp_extract_all(text, F.lit(BARE_LINK), F.lit(1)), lambda u: ~u.rlike(DEGREE) & (u.contains("/") | ~F.lower(u).rlike(r"^[a-z]{1,2}\.")))
    every = F.filter(F.transform(F.concat(F.regexp_extract_all(text, F.lit(PROFILES), F.lit(0)), bare), lambda u: F.regexp_replace(u, r"[).,;:]+$", "")), lambda u: (u != "") & (~u.contains("@") | F.lower(u).rlike("^https?:")))
    key = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), r"^https?://", ""), r"^www\.|/+$", "")
    network = lambda u: F.when(F.lower(u).contains("linkedin.com/"), "LinkedIn").when(F.lower(u).rlike(r"(?:^|[/.])github\.com/"), "GitHub").otherwise(F.regexp_extract(u, r"^(?:https?://)?(?:www\.)?([^/?#]*)", 1))
    first = F.filter(every, lambda u, i: ~F.exists(F.slice(every, F.lit(1), i), lambda v: key(v) == key(u)))
    return F.transform(first, lambda u: F.struct(network(u).alias("network"), u.alias("url")))


def skills(text: Column) -> Column:
    """The items of a list line, 40 characters at most each, each once in any spelling; a label before a colon and stars are no part of them."""
    body = clean(F.regexp_replace(F.regexp_replace(text, BULLET, ""), r"^[^:]{2,30}:\s*", ""))
    parts = F.split(body, r"\s*(?:,|\||•|·|;|\s{3,}|//)\s*")
    items = F.filter(F.transform(parts, lambda p: F.regexp_replace(clean(F.regexp_replace(F.regexp_replace(p, r"(?i)^and\s+", ""), STARS, " ")), "[.]$", "")), lambda p: (p != "") & (F.length(p) <= 40))
    return F.filter(items, lambda s, i: ~F.exists(F.slice(items, F.lit(1), i), lambda o: F.lower(o) == F.lower(s)))


def is_header(text: Column, bulleted: Column) -> Column:
    """Whether a line opens an entry: it holds dates and a few letters more, isn't long, and isn't "2024: did so"."""

    def told(r: Column) -> Column:
        rest = F.regexp_replace(F.replace(text, r["raw"], F.lit(" ")), "[^A-Za-z]", "")
        closing = ~r["single"] | F.btrim(text).rlike("(?:19|20)[0-9]{2}$")
        note = text.rlike(r"(?i)^\s*(?:19|20)[0-9]{2}\s*[:\-–]?\s+[a-z]") & ~F.substring(text, 1, 25).rlike(RANGE)
        return r.isNotNull() & closing & ~note & (F.length(rest) >= 3) & (F.length(text) <= 110)

    return F.coalesce(~bulleted & let(date_range(text), told), F.lit(False))
