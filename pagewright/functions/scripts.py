"""Scripts of India: code points, syllables, comparison keys and checked readings of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.resume_text import let

# The nine scripts by block of 128 code points from U+0900 with their languages, characters of other scripts that tell broken text, and letters by their place in a block.
SCRIPTS = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam"]
LANGUAGES = ["hin", "ben", "pan", "guj", "ori", "tam", "tel", "kan", "mal"]
INDIC = r"[\x{0900}-\x{0D7F}\x{A8E0}-\x{A8FF}\x{1CD0}-\x{1CFF}]"
MIXED = (
    r"[\x{A2}-\x{A6}\x{A8}\x{AA}\x{AC}\x{AF}\x{B2}-\x{B6}\x{B8}-\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{036F}\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{E000}-\x{F8FF}\x{F900}-\x{FAFF}]"
)
PRE_BASE = [0x093F, 0x094E, 0x09BF, 0x09C7, 0x09C8, 0x0A3F, 0x0ABF, 0x0B47, 0x0B48, 0x0BC6, 0x0BC7, 0x0BC8, 0x0D46, 0x0D47, 0x0D48]
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
DASHES = r"[-\x{2010}-\x{2015}\x{2212}]"
DIGITS = r"[0-9\x{0966}-\x{096F}]"


def code_point(c: Column) -> Column:
    return F.ascii(c)


def points(text: Column) -> Column:
    """The code points of a text."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code_point)


def script(cp: Column) -> Column:
    """The script of a code point; null for others than the nine."""
    block = F.get(F.array(*map(F.lit, SCRIPTS)), F.floor((cp - 0x900) / 128).cast("int"))
    return F.when(cp.between(0x900, 0xD7F), block).when(cp.between(0xA8E0, 0xA8FF) | cp.between(0x1CD0, 0x1CFF), SCRIPTS[0])


def scripts_in(text: Column) -> Column:
    """The scripts of a text in the order in which they first come."""
    return F.array_compact(F.array_distinct(F.transform(points(text), script)))


def has_indic(text: Column) -> Column:
    return text.rlike(INDIC)


def first_script(text: Column) -> Column:
    first = F.regexp_extract(text, f"({INDIC})", 1)
    return F.when(first != "", script(code_point(first)))


def languages(text: Column) -> Column:
    """The languages to read a text with, joined by +: those of its scripts, hin if there are none, and eng with Latin letters."""
    block = lambda cp: F.when(cp.between(0x900, 0xD7F), F.get(F.array(*map(F.lit, LANGUAGES)), F.floor((cp - 0x900) / 128).cast("int")))
    found = F.array_compact(F.array_distinct(F.transform(points(text), block)))
    named = F.when(F.size(found) == 0, F.array(F.lit("hin"))).otherwise(found)
    return F.array_join(F.when(text.rlike("[A-Za-z]"), F.array_append(named, F.lit("eng"))).otherwise(named), "+")


def place(cp: Column, more: bool) -> Column:
    """The class of a code point in a syllable: C consonant, N dot below, H virama, V vowel sign, A sign above, I vowel, L other letter, X other; with `more`, P sign before its base, J joiner, S space; without, M tippi or addak."""
    o, block = cp.bitwiseAND(0x7F), cp.bitwiseAND(0xFF80)
    malayalam, ra_va = block == 0x0D00, block.isin(0x0980, 0x0B00) & o.isin(0x70, 0x71)
    consonant = o.between(0x15, 0x39) | o.between(0x58, 0x5F) | malayalam & (o.between(0x54, 0x56) | (o >= 0x7A)) | ra_va
    vowel_sign = o.between(0x3E, 0x4C) | o.isin(0x62, 0x63, 0x57) | ~malayalam & o.isin(0x55, 0x56)
    inside = F.when(consonant, "C").when(o == 0x3C, "N").when(o == 0x4D, "H").when(vowel_sign, "V").when(o.between(0x01, 0x03), "A").when(o.between(0x04, 0x14) | o.isin(0x60, 0x61), "I")
    if more:
        return F.when(cp.isin(0x200C, 0x200D), "J").when(~cp.between(0x900, 0xD7F), F.when(cp.isin(9, 10, 11, 12, 13, 32, 0xA0), "S").otherwise("X")).when(cp.isin(PRE_BASE), "P").otherwise(inside.otherwise("L"))
    return F.when(~cp.between(0x900, 0xD7F), "X").otherwise(inside.when((block == 0x0A00) & o.isin(0x70, 0x71), "M").otherwise("L"))


def classes(text: Column) -> Column:
    """The classes of a text's code points, as a string."""
    return F.array_join(F.transform(points(text), lambda cp: place(cp, True)), "")


def malformed(text: Column) -> Column:
    """Whether a text in one of the scripts copies out broken: a sign without the letter it belongs to, or letters of scripts that come from a wrong map."""
    told = F.array_join(F.transform(F.filter(points(text), lambda cp: ~cp.isin(0x200C, 0x200D)), lambda cp: place(cp, False)), "")
    # a vowel sign or virama without consonant or dot, a dot without consonant, a sign above without a letter
    alone = told.rlike("(^|[^CN])[VH]|(^|[^C])N|(^|[^CNVIAL])A|(^|[^CNVIALH])M")
    return F.when(~text.rlike(r"[\x{0900}-\x{0D7F}]"), F.lit(False)).otherwise(text.rlike(MIXED) | alone)


def plain(text: Column) -> Column:
    """A reading without characters of no width, its white space single. Texts come in composed form."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, ""), r"[\s\x{00A0}]+", " "))


def compare_key(text: Column) -> Column:
    """What two readings are compared by: no spaces, one kind of dash, dandas for bars."""
    return F.translate(F.regexp_replace(F.regexp_replace(plain(text), r"\s+", ""), DASHES + "+", "-"), "|", "।")


def letters(text: Column) -> Column:
    return F.regexp_replace(plain(text), r"[^\p{L}\p{M}]", "")


def keep_digits(best: Column, layer: Column) -> Column:
    """A reading with the digits of the text layer: run by run if there are as many runs, else digit by digit if there are as many digits."""
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))

    def put(pattern: str, from_: Column) -> Column:
        gaps = F.split(best, pattern, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(from_, i), F.lit("")))), "")

    runs, ours = found(plain(layer), DIGITS + "+"), found(best, DIGITS + "+")
    each, own = found(plain(layer), DIGITS), found(best, DIGITS)
    some = (F.size(runs) > 0) & (F.size(ours) > 0)
    return F.when(some & (F.size(runs) == F.size(ours)), put(DIGITS + "+", runs)).when(some & (F.size(each) == F.size(own)), put(DIGITS, each)).otherwise(best)


def trim_edges(ocr: Column, refs: Column) -> Column:
    """A reading without the marks at its ends that none of the other readings has there; dashes stand for each other."""
    mark = r"[^\p{L}\p{M}\p{N}]"
    t = plain(ocr)

    def known(c: Column, at_start: bool) -> Column:
        end = lambda r: let(plain(r), lambda n: F.substring(n, F.lit(1), F.lit(1)) if at_start else F.right(n, F.lit(1)))
        return F.exists(refs, lambda r: (end(r) == c) | c.rlike(f"^{DASHES}$") & end(r).rlike(f"^{DASHES}$"))

    chars = F.filter(F.split(t, ""), lambda c: c != "")
    drop = lambda c, at_start: (c == " ") | c.rlike(f"^{mark}$") & ~known(c, at_start)
    first = F.get(F.filter(F.transform(chars, lambda c, i: F.when(~drop(c, True), i)), lambda i: i.isNotNull()), F.lit(0))
    last = F.element_at(F.concat(F.array(F.lit(-1)), F.filter(F.transform(chars, lambda c, i: F.when(~drop(c, False), i)), lambda i: i.isNotNull())), -1)
    return F.when(first.isNull() | (last < first), "").otherwise(F.array_join(F.slice(chars, first + 1, last - first + 1), ""))


def decision(layer: Column, flagged: Column, font: Column, complete: Column, learned: Column, ocr: Column, legacy: Column, rule: str = "letters", contradicts: Column | None = None) -> Column:
    """(decision, source): what becomes of a line with three readings, any but the layer null; the first rule that holds.

    A font of the old kind is always confirmed. A complete font reading that equals the layer makes it text; so does OCR
    that agrees with it, silently if the layer was flagged. A reading learned from the document needs the letters of
    OCR. All else is confirmed. The font must not contradict the layer: `contradicts` tells it by sure graphemes
    (readings.contradicted); without it, complete letters that differ do.
    """
    same = F.lit(False)
    if rule == "letters":
        same = (F.length(letters(layer)) > 0) & (letters(ocr) == letters(layer))
    elif rule == "exact":
        same = (F.length(letters(layer)) > 0) & (plain(ocr) == plain(layer))
    contra = F.coalesce(complete & (letters(font) != letters(layer)) if contradicts is None else contradicts, F.lit(False))
    exact = F.lit(rule == "letters") | (plain(font) == plain(ocr))
    by_font = ~flagged & font.isNotNull() & complete & ~learned & (compare_key(font) == compare_key(layer))
    by_ocr = ocr.isNotNull() & same & ~contra
    by_map = font.isNotNull() & learned & F.lit(rule != "never") & complete & ocr.isNotNull() & (F.length(letters(font)) > 0) & (letters(font) == letters(ocr)) & exact
    out = lambda d, s: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("source"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    asked = F.when(font.isNotNull(), F.when(learned, out("confirm", "learned")).otherwise(out("confirm", "font"))).when(ocr.isNotNull(), out("confirm", "ocr")).otherwise(out("confirm", "text layer"))
    told = F.when(yes(legacy), out("confirm", "legacy")).when(yes(by_font), out("text", "font")).when(yes(by_ocr), F.when(flagged, out("silent", "text layer")).otherwise(out("text", "text layer")))
    return told.when(yes(by_map), out("silent", "learned")).otherwise(asked)
