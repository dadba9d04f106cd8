"""The queries of readings. Rows take written cases in turn; the SQL holds what each case means, told by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import readings
from pagewright.plans.writing import facts

LEGACY = {"jftLVªh": "रजिस्ट्री", "fganh": "हिंदी", "dk;Z": "कार्य", "vkS": "औ", "vks": "ओ", "": "", "{ks=": "क्षेत्र", "deZ 😀": "कर्म 😀", "fo|k": "वि|ा"}
CHANAKYA = {"=k": "त्र", "/ku": "धान", "jftLVªh": "रजिस्ट्री"}
#: The font's graphemes, each after + if sure or - if not / OCR: the best guess, and whether the sure ones contradict OCR.
MERGED = {
    "+क+ख+ग/कघग": ("कखग", True), "+क-ख+ग/कघग": ("कघग", False), "+क+ग/कखग": ("कग", False), "+क-ग/कखग": ("कखग", False), "+क+ +ख/कख": ("कख", False), "+क-ख+ग/कग": ("कग", False), "+a+—+b/a--b": ("a--b", False), "+a+x-y+b/ab": ("axb", False), "+a/": ("a", True),
}
#: A text / another: the text, with what differs in brackets.
MARKED = {"abc/abd": "ab[c]", "ab/abc": "ab[‸]", "x a/a": "[x ]a", "same/same": "same", "कि/की": "[कि]"}
ONTO = {"क-ख 1/क ख": "क-ख 1", "ab. c/ax c": "ax c", "12 a/a": "12 a", "a/": ""}


def side(c, i: int):
    return F.coalesce(F.get(F.split(c, "/"), F.lit(i)), F.lit(""))


def units(c):
    return F.regexp_extract_all(side(c, 0), F.lit(r"(?s)[+-](.)"), F.lit(1))


def sure(c):
    return F.transform(F.regexp_extract_all(side(c, 0), F.lit(r"(?s)([+-])."), F.lit(1)), lambda s: s == "+")


def shown(c):
    return F.array_join(F.transform(readings.differences(side(c, 0), side(c, 1)), lambda s: F.when(s["differs"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")


CASES = {
    "legacy_hindi": facts(LEGACY, "said", ["text"], lambda c: [readings.legacy_text(c)]),
    "legacy_chanakya": facts(CHANAKYA, "said", ["text"], lambda c: [readings.legacy_text(c, "chanakya")]),
    "merged_readings": facts(MERGED, "said", ["best", "contradicted"], lambda c: [readings.merged_reading(units(c), sure(c), side(c, 1)), readings.contradicted(units(c), sure(c), side(c, 1))]),
    "marked_differences": facts(MARKED, "said", ["marked"], lambda c: [shown(c)]),
    "letters_onto": facts(ONTO, "said", ["reading"], lambda c: [readings.letters_onto(side(c, 0), side(c, 1))]),
}
QUERIES = {k: q for k, (q, _) in CASES.items()}
ORACLE_SQL = {k: s for k, (_, s) in CASES.items()}
