"""Names of fonts: families, traits and substitutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names say of a font; substitutes by family in the order they are tried (family, key, whose widths it has); fonts that store Hindi as Latin codes.
BOLD, ITALIC = "bold|black|heavy|semibold|demi", "italic|oblique|-it$|,it$"
MONO, SERIF, SANS = "mono|courier|consol|menlo|typewriter", "serif|times|roman|georgia|garamond|minion|cambria|palatino|book", "sans"
STYLES = "(bold|italic|oblique|semibold|demibold|demi|regular|medium|book|roman|black|heavy|light|it|mt|ps|bd|bi)"
SUBSTITUTES = [
    ("arial|helvetica|arimo|liberationsans|nimbussans|freesans|helv|swiss", "LiberationSans", "Arial/Helvetica"),
    ("timesnewroman|times|tinos|liberationserif|nimbusrom|freeserif|tmsrmn|tiroman", "LiberationSerif", "Times"),
    ("couriernew|courier|cousine|liberationmono|nimbusmon|freemono", "LiberationMono", "Courier"),
    ("calibri|carlito", "Carlito", "Calibri"),
    ("cambria|caladea", "Caladea", "Cambria"),
    ("roboto(?!mono|slab|condensed|flex|serif)", "Roboto", None),
    ("opensans", "OpenSans", None),
    ("lato", "Lato", None),
]
LEGACY_HINDI = [
    ("kru?tidev|kritidev", "Kruti Dev"), ("devlys", "DevLys"), ("walkmanchanakya", "Walkman-Chanakya"), ("chanakya", "Chanakya"),
    ("devnagari(?!.*unicode)", "Devnagari (legacy)"), ("shivaji", "Shivaji"), ("^apsc?dv", "APS-DV"), ("^(dv|dvb|dvo|dvbo)tt", "C-DAC DV-TT"),
]


def clean_name(name: Column) -> Column:
    """Without the prefix of a subset."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), "^[A-Z]{6}[+]", "")


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(clean_name(name), r"-\d{3,}$", "")), "[^a-z0-9]", "")


def family(normal: Column) -> Column:
    """A normal name without the styles at its end. A name of styles alone is ''."""
    return F.regexp_replace(normal, STYLES + "+$", "")


def traits(name: Column) -> Column:
    """(bold, italic, mono, serif) as the name tells them."""
    n = F.lower(clean_name(name))
    mono = n.rlike(MONO)
    return F.struct(n.rlike(BOLD).alias("bold"), n.rlike(ITALIC).alias("italic"), mono.alias("mono"), (~mono & n.rlike(SERIF) & ~n.rlike(SANS)).alias("serif"))


def style(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "BoldItalic").when(bold, "Bold").when(italic, "Italic").otherwise("Regular")


def substitutes(name: Column) -> Column:
    """(near, widths_of, far): a font of the same widths or design, if one is known, and one by traits that has all letters."""
    t, n = traits(name), normal_name(name)
    near = widths = F.lit(None).cast("string")
    for pattern, key, of in reversed(SUBSTITUTES):
        near = F.when(n.rlike(pattern), F.concat_ws("-", F.lit(key), style(t["bold"], t["italic"]))).otherwise(near)
        widths = F.when(n.rlike(pattern), F.lit(of).cast("string")).otherwise(widths)
    far = F.when(t["mono"], F.concat(F.lit("NotoSansMono-"), F.when(t["bold"], "Bold").otherwise("Regular")))
    far = far.otherwise(F.concat(F.when(t["serif"], "NotoSerif-").otherwise("NotoSans-"), style(t["bold"], t["italic"])))
    return F.struct(near.alias("near"), widths.alias("widths_of"), far.alias("far"))


def restyled(key: Column, bold: Column, italic: Column) -> Column:
    """A substitute's key with another style; the monospaced one has no italics."""
    mono = key.startswith("NotoSansMono")
    return F.concat(F.regexp_replace(key, "-(Regular|Bold|Italic|BoldItalic)$", ""), F.lit("-"), style(bold, italic & ~mono))


def legacy_hindi(name: Column) -> Column:
    """The kind of a font that stores Hindi as Latin codes; null for others."""
    n = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "^/?[A-Z]{6}[+]", "")), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for pattern, label in reversed(LEGACY_HINDI):
        out = F.when(n.rlike(pattern), label).otherwise(out)
    return out
