"""Scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is collapsed, months, and what reads as "present".
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}
PRESENT = "present|current|till|now|ongoing|today"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: an expression inside a lambda function is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states that a fold of an array passes through, one for each value.

    Appending copies an array, so the fold goes in chunks of the square root of the array's length: a long line takes
    time in proportion to the power of 1.5 of its length, in copies of references only.
    """

    def folded(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)), lambda i: F.slice(v, i * width + 1, width))
        within = lambda state, chunk: F.aggregate(chunk, F.array(state), lambda out, x: F.array_append(out, step(F.element_at(out, -1), x)))
        parts = F.aggregate(chunks, F.array(F.array(start)), lambda outs, chunk: F.array_append(outs, within(F.element_at(F.element_at(outs, -1), -1), chunk)))
        return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(chunks)), lambda part: F.slice(part, F.lit(2), F.size(part) - 1)))

    return let(values, folded)


def js_round(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x.cast("double") + 0.5)


def clean(text: Column) -> Column:
    """One space for any white space, none before a comma, semicolon or colon, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), r" +([,;:])", "$1"))


def mask_digits(text: Column) -> Column:
    """Text as running headers are compared: numbers become #, white space one space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "#"), SPACE + "+", " "))


def four_digit_year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") > 50, "19").otherwise("20"), y)).otherwise(y)


def norm_date(text: Column, ref: Column | None = None) -> Column:
    """A written date as YYYY-MM, YYYY, '' for present words, or as it is. The month isn't checked."""
    s = F.regexp_replace(F.lower(F.btrim(F.coalesce(text, F.lit("")))), "'", "")
    named = r"^([a-z]{3})[a-z]*\.?\s*,?\s*(\d{2,4})$"
    month = F.regexp_extract(s, named, 1)
    number = F.lit(None).cast("string")
    for k, v in MONTHS.items():
        number = F.when(month == k, v).otherwise(number)
    slashed = r"^(\d{1,2})[/.](\d{2,4})$"
    out = F.when((s == "") | s.rlike(PRESENT), "")
    out = out.when(s.rlike(named) & number.isNotNull(), F.concat_ws("-", four_digit_year(F.regexp_extract(s, named, 2)), number))
    out = out.when(s.rlike(slashed), F.concat_ws("-", four_digit_year(F.regexp_extract(s, slashed, 2)), F.lpad(F.regexp_extract(s, slashed, 1), 2, "0")))
    if ref is not None:
        out = out.when(s.rlike(r"^\d{2}$") & (F.coalesce(ref, F.lit("")) != ""), F.concat(F.substring(ref, 1, 2), s))
    return out.otherwise(s)


def parse_size(text: Column) -> Column:
    """'350 KB' as bytes; a bare number is KB; null if it can't be read or is under 10,240."""
    pattern = r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*(kb|k|mb|m|b|bytes)?\s*$"
    value = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    size = js_round(value * F.when(unit.startswith("m"), 1048576.0).when(unit.startswith("k") | (unit == ""), 1024.0).otherwise(1.0))
    return F.when(text.rlike(pattern) & (size >= 10240), size)


def parse_ranges(spec: Column, n: Column) -> Column:
    """'1-3, 5, 8-' over n pages as (groups, error): groups of page numbers from 0, or the kind of the first error."""
    tidy = F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s*[-–—]\s*", "-")
    parts = F.filter(F.split(tidy, r"[,;\s]+"), lambda p: p != "")

    def one(p: Column) -> Column:
        # each number is read once: in lambda functions an expression is computed at every place where it stands
        a = F.coalesce(F.regexp_extract(p, r"^(\d*)", 1).try_cast("int"), F.lit(1))
        end = F.when(p.contains("-"), F.coalesce(F.regexp_extract(p, r"-(\d*)$", 1).try_cast("int"), n.cast("int")))

        def told(t: Column) -> Column:
            a, b = t["a"], F.when(t["open"], t["end"]).otherwise(t["a"])
            error = F.when(~t["ok"], "unreadable").when(a > b, "reversed").when((a < 1) | (b > n), "outside")
            return let(error, lambda e: F.struct(F.when(e.isNull(), F.sequence(a - 1, F.greatest(a, b) - 1)).alias("pages"), e.alias("error")))

        return let(F.struct(p.rlike(r"^(\d+|\d+-\d*|-\d+)$").alias("ok"), p.contains("-").alias("open"), a.alias("a"), end.alias("end")), told)

    def of(read: Column) -> Column:
        error = F.when(F.size(read) == 0, "empty").otherwise(F.get(F.filter(F.transform(read, lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0)))
        return let(error, lambda e: F.struct(F.when(e.isNull(), F.transform(read, lambda r: r["pages"])).alias("groups"), e.alias("error")))

    return let(F.transform(parts, one), of)


def written_date(date: Column) -> Column:
    """YYYY-MM as 'Mon YYYY'; anything else as it is, null as ''."""
    names = F.array(*[F.lit(m.title()) for m in MONTHS])
    month = F.get(names, F.regexp_extract(date, r"^\d{4}-(\d{2})", 1).try_cast("int") - 1)
    return F.when(date.rlike(r"^\d{4}-(0[1-9]|1[0-2])"), F.concat_ws(" ", month, F.substring(date, 1, 4))).otherwise(F.coalesce(date, F.lit("")))


def written_range(start: Column, end: Column) -> Column:
    """'Mon YYYY – Mon YYYY'; an open end is Present, without a start the end alone."""
    a, b = written_date(start), written_date(end)
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(" – "), F.when(b == "", "Present").otherwise(b)))


def split_title(text: Column) -> Column:
    """'X at Y', or X and Y between separators, as (title, place)."""
    t = clean(text)
    at = r"(?i)^(.+?)\s+(?:at|@)\s+(.+)$"
    parts = F.filter(F.split(t, r"\s*(?:\||·|•|—|–|\s-\s|,\s)\s*"), lambda p: p != "")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), ", ")
    title = F.when(t.rlike(at), F.regexp_extract(t, at, 1)).when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise(t)
    place = F.when(t.rlike(at), F.regexp_extract(t, at, 2)).when(F.size(parts) >= 2, rest).otherwise("")
    return F.struct(title.alias("title"), place.alias("place"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """Shares of 0 to 1 as #rrggbb; what lies outside is cut off."""
    byte = lambda v: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), js_round(v * 255))).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of shares of 0 to 1."""
    part = lambda v: F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return part(r) * 0.2126 + part(g) * 0.7152 + part(b) * 0.0722


def readable_color(color: Column, steps: int = 60) -> Column:
    """#rrggbb darkened by a twentieth at a time until its contrast with white is 4.5, `steps` times at most; null if it isn't a colour."""
    form = "(?i)^#?([0-9a-f]{6})$"
    digits = F.regexp_extract(color, form, 1)
    start = F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("double"))
    dark = lambda c: F.lit(1.05) / (luminance(*[F.get(c, F.lit(i)) / 255 for i in range(3)]) + 0.05) >= 4.5
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda c, _: F.when(dark(c), c).otherwise(F.transform(c, lambda v: v * 0.95)))
    return F.when(color.rlike(form), hex_color(*[F.get(end, F.lit(i)) / 255 for i in range(3)]))


def cmyk_color(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Shares of the four inks as #rrggbb."""
    return hex_color((1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k))


def hex_number(color: Column) -> Column:
    """#rgb or #rrggbb as the number of its bytes; 0 if it can't be read."""
    h = F.regexp_replace(F.coalesce(color, F.lit("#000")), "#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.coalesce(F.conv(F.regexp_extract(h, "^[0-9A-Fa-f]+", 0), 16, 10).try_cast("long"), F.lit(0).cast("long"))


def hex_string(data: Column) -> Column:
    """Bytes as a hexadecimal string of a content stream."""
    return F.concat(F.lit("<"), F.lower(F.hex(data)), F.lit(">"))


def base_name(name: Column, default: str = "document") -> Column:
    """A file name without .pdf and without characters that file names can't have."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit(default)), r"(?i)\.pdf$", ""), r'[\\/:*?"<>|]+', "_")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))
