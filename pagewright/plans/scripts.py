"""The queries of the script functions. Rows take written cases in turn; the SQL holds what each case means, told by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scripts
from pagewright.plans.catalog import read
from pagewright.plans.checker import quoted
from pagewright.plans.writing import facts

#: A text: its scripts, its first script, the languages to read it with, the classes of its code points, whether it is malformed.
TEXTS = {
    "हिंदी": ("Devanagari", "Devanagari", "hin", "CPACV", False), "ABC हिंदी தமிழ்": ("Devanagari,Tamil", "Devanagari", "hin+tam+eng", "XXXSCPACVSCCVCH", False), "िहंदी": ("Devanagari", "Devanagari", "hin", "PCACV", True),
    "plain": ("", None, "hin+eng", "XXXXX", False), "": ("", None, "hin", "", False), "Ǒहंदȣ": ("Devanagari", "Devanagari", "hin", "XCACX", True), "ক্ষ": ("Bengali", "Bengali", "ben", "CHC", False),
    "अंक ५": ("Devanagari", "Devanagari", "hin", "IACSL", False), "ਪੰਜਾਬੀ": ("Gurmukhi", "Gurmukhi", "pan", "CLCVCV", False), "क़": ("Devanagari", "Devanagari", "hin", "CN", False), "्क": ("Devanagari", "Devanagari", "hin", "HC", True),
    "മലയാളം": ("Malayalam", "Malayalam", "mal", "CCCVCA", False), "ꣲ": ("Devanagari", "Devanagari", "hin", "X", False), "ಕನ್ನಡ తెలుగు": ("Kannada,Telugu", "Kannada", "kan+tel", "CCHCCSCVCVCV", False),
}
#: A reading: its plain form, its key and its letters.
READINGS = {" a  b‍ ": ("a b", "ab", "ab"), "क — ख | ग": ("क — ख | ग", "क-ख।ग", "कखग"), "x -- y": ("x -- y", "x-y", "xy"), "हिंदी 12": ("हिंदी 12", "हिंदी12", "हिंदी"), "": ("", "", "")}
#: best / layer: the reading with the layer's digits.
DIGITS = {"a 4 b 22/x 1 y 33": "a 1 b 33", "a4b/x 12 y": "a12b", "a 12/b 1 c 2": "a 12", "१ of 3/7 8": "7 of 8", "none/7": "none", "4 4/१२": "१ २"}
#: OCR / other readings between commas: the reading without what is only at its ends.
EDGES = {") word:/word": "word", "- word/– x": "- word", "(word)/(word,a)": "(word)", "…/a": "", "word । /word।": "word ।", "« a b/a b": "a b"}
#: layer / flagged / font / complete / learned / ocr / legacy: decision and source.
DECISIONS = {
    "a b/n/ab/y/n//n": ("text", "font"), "a b/y/ab/y/n//n": ("confirm", "font"), "ab/n//n/n/a b/n": ("text", "text layer"), "ab/y//n/n/a-b/n": ("silent", "text layer"), "ab/y/ac/y/n/ab/n": ("confirm", "font"), "ax/y/ab/y/y/ab/n": ("silent", "learned"),
    "ax/y/ab/n/y/ab/n": ("confirm", "learned"), "ab/n/ab/y/n/ab/y": ("confirm", "legacy"), "ab/y//n/n//n": ("confirm", "text layer"), "ab/y//n/n/xy/n": ("confirm", "ocr"), "12/y//n/n/12/n": ("confirm", "ocr"),
}


def piece(c, i: int):
    return F.nullif(F.get(F.split(c, "/"), F.lit(i)), F.lit(""))


def yes(c, i: int):
    return F.coalesce(piece(c, i) == "y", F.lit(False))


CASES = {
    "scripts": facts(TEXTS, "said", ["scripts", "first", "languages", "classes", "malformed"], lambda c: [F.array_join(scripts.scripts_in(c), ","), scripts.first_script(c), scripts.languages(c), scripts.classes(c), scripts.malformed(c)]),
    "readings": facts(READINGS, "said", ["plain", "key", "letters"], lambda c: [scripts.plain(c), scripts.compare_key(c), scripts.letters(c)]),
    "kept_digits": facts(DIGITS, "said", ["best"], lambda c: [scripts.keep_digits(piece(c, 0), piece(c, 1))]),
    "trimmed_edges": facts(EDGES, "said", ["reading"], lambda c: [scripts.trim_edges(piece(c, 0), F.split(piece(c, 1), ","))]),
    "decisions": facts(DECISIONS, "said", ["decision", "source"], lambda c: [scripts.decision(piece(c, 0), yes(c, 1), piece(c, 2), yes(c, 3), yes(c, 4), piece(c, 5), yes(c, 6))[n] for n in ("decision", "source")]),
}


def bad_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(font, n, bad, unreliable): fonts of the part brands, of whose lines in Indian scripts a quarter and two at least are malformed."""
    keys = list(TEXTS)
    text = F.get(F.array(*map(F.lit, keys)), (F.col("p_partkey") % len(keys)).cast("int"))
    lines = read(spark, sf_dir, "part").select(F.col("p_brand").alias("font"), text.alias("t")).where(scripts.has_indic(F.col("t")))
    out = lines.groupBy("font").agg(F.count("*").alias("n"), F.count_if(scripts.malformed(F.col("t"))).alias("bad"))
    return out.withColumn("unreliable", (F.col("bad") >= 2) & (F.col("bad") >= 0.25 * F.col("n")))


QUERIES = {**{k: q for k, (q, _) in CASES.items()}, "bad_fonts": bad_fonts}
INDIC_CASES = ", ".join(f"({i}, {quoted(k)}, {str(v[4]).lower()})" for i, (k, v) in enumerate(TEXTS.items()) if v[0])
ORACLE_SQL = {
    **{k: s for k, (_, s) in CASES.items()},
    "bad_fonts": f"""SELECT p_brand AS font, count(*) AS n, count(*) FILTER (bad) AS bad, count(*) FILTER (bad) >= 2 AND count(*) FILTER (bad) >= 0.25::DOUBLE * count(*) AS unreliable
FROM part JOIN (VALUES {INDIC_CASES}) AS f(i, t, bad) ON p_partkey % {len(TEXTS)} = i GROUP BY p_brand""",
}
