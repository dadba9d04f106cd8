"""The queries of the geometry and font functions and the SQL that checks them, on numbers and names made from table keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import fonts, geometry, scalars
from pagewright.plans.catalog import read

#: Names of fonts and annotation kinds that rows take in turn.
FONTS = ["ABCDEF+Arial-BoldMT", "Times New Roman,Italic", "CourierNew-BoldItalic", "Calibri-Light", "Roboto-MediumItalic", "RobotoMono-Regular", "GEORGIA-Demi", "Lato-SemiBoldIt", "KRUTI_DEV_010", "BCDEFG+Devnagari-ChanakyaNormalA", "Kokila", "OpenSans-12345", "NotoSans-It"]
KINDS = ["pen", "highlight", "line", "arrow", "rect", "ellipse", "whiteout", "text", "image"]


def number(k: Column, times: int, over: int, less: int = 0) -> Column:
    """A whole number from a key, as a double."""
    return (k * times % over - less).cast("double")


def named(array: Column, names: list[str]) -> list[Column]:
    return [geometry.at(array, i).alias(n) for i, n in enumerate(names)]


def one_of(values: list[str], k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def turn(k: Column) -> Column:
    return geometry.total_rotation(((k % 5) * 90 - 90).cast("int"), (k % 3 * 90).cast("int"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    m = F.array(number(k, 1, 3), number(k, 1, 5, 2), number(k, 1, 7, 3), number(k, 1, 2), number(k, 1, 11), number(k, 3, 13))
    n = F.array(number(k, 5, 4), number(k, 7, 5, 2), number(k, 3, 6), number(k, 2, 7, 1), number(k, 5, 9), number(k, 1, 8))
    out = read(spark, sf_dir, "part").select("p_partkey", m.alias("m"), n.alias("n"))
    out = out.select("p_partkey", geometry.product(F.col("m"), F.col("n")).alias("p"), geometry.inverse(F.col("m")).alias("i"), geometry.moved_point(F.col("m"), F.lit(3.0), F.lit(4.0)).alias("t"), geometry.user_delta(F.col("m"), F.lit(0.0), F.lit(-14.0)).alias("d"), geometry.is_turned(F.col("m")).alias("turned"))
    return out.select("p_partkey", *named(F.col("p"), [f"p{i}" for i in range(6)]), *named(F.col("i"), [f"i{i}" for i in range(6)]), *named(F.col("t"), ["tx", "ty"]), *named(F.col("d"), ["dx", "dy"]), "turned")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    points = F.array(*[F.array(number(k, a, 97), number(k, b, 89)) for a, b in ((3, 5), (7, 11), (13, 2))])
    other = F.array(number(k, 5, 40), number(k, 3, 40), number(k, 5, 40) + 30, number(k, 3, 40) + 30)
    corners = F.array(number(k, 17, 50), number(k, 19, 50), number(k, 23, 50), number(k, 29, 50))
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.box_of(points).alias("b"), F.when(k % 7 != 0, other).alias("o"), geometry.ordered_box(corners).alias("r"))
    out = out.select("*", geometry.common_box(F.col("b"), F.col("o")).alias("c"), geometry.same_box(F.col("b"), F.col("o")).alias("same"))
    out = out.select("*", geometry.path_poke(F.col("l_linenumber") % 2 == 0, F.col("b")).alias("poke"), geometry.grown(F.col("b"), F.array(F.struct(F.array(F.col("b")).alias("grow"), (k % 5 - 3).cast("double").alias("dy")), F.struct(F.array(F.col("r")).alias("grow"), F.lit(-2.0).alias("dy")))).alias("grown"))
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *[x for a in "bcr" for x in named(F.col(a), [f"{a}{i}" for i in range(4)])], "same", "poke", "grown")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y, width, size = number(k, 3, 400), number(k, 7, 800), number(k, 11, 120), number(k, 5, 9) + 6
    asc, desc = F.when(k % 3 == 0, 0.9), F.when(k % 4 == 0, -0.3)
    m = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), number(k, 1, 4, 1))
    out = read(spark, sf_dir, "part").select("p_partkey", geometry.line_box(x, y, width, size, asc, desc).alias("l"), geometry.probe_box(x, y, width, size).alias("q"), geometry.show_box(m, x, y, x - number(k, 1, 9, 4), number(k, 1, 2) * 12).alias("s"))
    return out.select("p_partkey", *[c for a in "lqs" for c in named(F.col(a), [f"{a}{i}" for i in range(4)])])


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    out = read(spark, sf_dir, "part").select("p_partkey", turn(k).cast("long").alias("rotation"), number(k, 1, 300) + 300, number(k, 1, 400) + 400).toDF("p_partkey", "rotation", "w", "h")
    r, w, h = F.col("rotation"), F.col("w"), F.col("h")
    out = out.select("p_partkey", "rotation", geometry.display_size(w, h, r).alias("s"), geometry.display_delta(r, F.lit(3.0), F.lit(5.0)).alias("d"), geometry.display_matrix(r, F.lit(10.0), F.lit(20.0), w, h).alias("m"), geometry.turned_right(F.lit(30.0), F.lit(40.0), h).alias("cw"), geometry.turned_left(F.lit(30.0), F.lit(40.0), w).alias("ccw"))
    return out.select("p_partkey", "rotation", *named(F.col("s"), ["sw", "sh"]), *named(F.col("d"), ["dx", "dy"]), *named(F.col("m"), [f"m{i}" for i in range(6)]), *named(F.col("cw"), ["cwx", "cwy"]), *named(F.col("ccw"), ["ccwx", "ccwy"]))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of an annotation, on the page too, before and after a quarter turn to the right of a page 800 high."""
    k = F.col("o_orderkey")
    kind = one_of(KINDS, k)
    points = F.array(*[F.array(number(k, a, 300), number(k, b, 700)) for a, b in ((3, 5), (7, 11))])
    out = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), points.alias("points"), number(k, 13, 200).alias("x"), number(k, 17, 600).alias("y"), number(k, 3, 90).alias("w"), number(k, 5, 70).alias("h"), number(k, 1, 4).alias("pen"))
    cols = ["kind", "points", "x", "y", "w", "h"]
    out = out.select("*", geometry.annotation_box(*map(F.col, cols), F.col("pen")).alias("b"), geometry.turned_annotation(*map(F.col, cols), F.lit(800.0)).alias("t"))
    out = out.select("*", geometry.annotation_on_page(F.col("b"), F.lit(10.0), F.lit(820.0)).alias("p"), geometry.annotation_box(F.col("kind"), F.col("t.points"), F.col("t.x"), F.col("t.y"), F.col("t.w"), F.col("t.h"), F.col("pen")).alias("u"))
    return out.select("o_orderkey", "kind", *[c for a in "bpu" for c in named(F.col(a), [f"{a}{i}" for i in range(4)])])


def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "part").select("p_partkey", one_of(FONTS, F.col("p_partkey")).alias("font"))
    n = fonts.normal_name(F.col("font"))
    out = out.select("*", fonts.clean_name(F.col("font")).alias("clean"), n.alias("normal"), fonts.family(n).alias("family"), fonts.traits(F.col("font")).alias("t"), fonts.substitutes(F.col("font")).alias("s"), fonts.legacy_hindi(F.col("font")).alias("legacy"))
    bold, italic = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0
    return out.select("p_partkey", "font", "clean", "normal", "family", "t.bold", "t.italic", "t.mono", "t.serif", "s.near", "s.widths_of", "s.far", "legacy", fonts.restyled(F.col("s.far"), bold, italic).alias("restyled"))


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = number(k, 7919, 200_003, 100_000) / 32_000
    cmyk = [number(k, a, 101) / 100 for a in (3, 7, 11, 13)]
    hexes = F.concat(F.lit("#"), F.substring(F.lower(F.hex(k * 7919)), 1, 3))
    return read(spark, sf_dir, "part").select("p_partkey", v.alias("v"), geometry.number_text(v).alias("said"), scalars.cmyk_color(*cmyk).alias("cmyk"), scalars.hex_number(hexes).alias("rgb"), hexes.alias("short"), scalars.hex_string(F.encode("p_brand", "UTF-8")).alias("bytes"), scalars.base_name(F.concat("p_name", F.lit(" a/b:c.PDF"))).alias("base"))


QUERIES = {"matrices": matrices, "boxes": boxes, "line_boxes": line_boxes, "page_turns": page_turns, "annotations": annotations, "font_names": font_names, "number_forms": number_forms}

#: What the names of FONTS mean, told by hand: clean, normal, family, bold, italic, mono, serif, near, widths_of, far, legacy.
FONT_FACTS = [
    ("Arial-BoldMT", "arialboldmt", "arial", True, False, False, False, "LiberationSans-Bold", "Arial/Helvetica", "NotoSans-Bold", None),
    ("Times New Roman,Italic", "timesnewromanitalic", "timesnew", False, True, False, True, "LiberationSerif-Italic", "Times", "NotoSerif-Italic", None),
    ("CourierNew-BoldItalic", "couriernewbolditalic", "couriernew", True, True, True, False, "LiberationMono-BoldItalic", "Courier", "NotoSansMono-Bold", None),
    ("Calibri-Light", "calibrilight", "calibri", False, False, False, False, "Carlito-Regular", "Calibri", "NotoSans-Regular", None),
    ("Roboto-MediumItalic", "robotomediumitalic", "roboto", False, True, False, False, "Roboto-Italic", None, "NotoSans-Italic", None),
    ("RobotoMono-Regular", "robotomonoregular", "robotomono", False, False, True, False, None, None, "NotoSansMono-Regular", None),
    ("GEORGIA-Demi", "georgiademi", "georgia", True, False, False, True, None, None, "NotoSerif-Bold", None),
    ("Lato-SemiBoldIt", "latosemiboldit", "lato", True, False, False, False, "Lato-Bold", None, "NotoSans-Bold", None),
    ("KRUTI_DEV_010", "krutidev010", "krutidev010", False, False, False, False, None, None, "NotoSans-Regular", "Kruti Dev"),
    ("Devnagari-ChanakyaNormalA", "devnagarichanakyanormala", "devnagarichanakyanormala", False, False, False, False, None, None, "NotoSans-Regular", "Chanakya"),
    ("Kokila", "kokila", "kokila", False, False, False, False, None, None, "NotoSans-Regular", None),
    ("OpenSans-12345", "opensans", "opensans", False, False, False, False, "OpenSans-Regular", None, "NotoSans-Regular", None),
    ("NotoSans-It", "notosansit", "notosans", False, True, False, False, None, None, "NotoSans-Italic", None),
]


def literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def n_(times: int, over: int, less: int = 0, k: str = "k") -> str:
    return f"({k} * {times} % {over} - {less})::DOUBLE"


def cells(name: str, parts: list[str]) -> str:
    return ", ".join(f"{p} AS {name}{i}" for i, p in enumerate(parts))


ORACLE_SQL = {
    "matrices": f"""WITH q AS (SELECT p_partkey, {n_(1, 3, k='p_partkey')} AS a, {n_(1, 5, 2, 'p_partkey')} AS b, {n_(1, 7, 3, 'p_partkey')} AS c, {n_(1, 2, k='p_partkey')} AS d, {n_(1, 11, k='p_partkey')} AS e, {n_(3, 13, k='p_partkey')} AS f,
{n_(5, 4, k='p_partkey')} AS a2, {n_(7, 5, 2, 'p_partkey')} AS b2, {n_(3, 6, k='p_partkey')} AS c2, {n_(2, 7, 1, 'p_partkey')} AS d2, {n_(5, 9, k='p_partkey')} AS e2, {n_(1, 8, k='p_partkey')} AS f2 FROM part), w AS (SELECT *, nullif(a * d - b * c, 0) AS det FROM q)
SELECT p_partkey, a * a2 + b * c2 AS p0, a * b2 + b * d2 AS p1, c * a2 + d * c2 AS p2, c * b2 + d * d2 AS p3, e * a2 + f * c2 + e2 AS p4, e * b2 + f * d2 + f2 AS p5,
d / det AS i0, -b / det AS i1, -c / det AS i2, a / det AS i3, (c * f - d * e) / det AS i4, (b * e - a * f) / det AS i5, a * 3 + c * 4 + e AS tx, b * 3 + d * 4 + f AS ty, d / det * 0 + -c / det * -14 AS dx, -b / det * 0 + a / det * -14 AS dy,
abs(b) > 0.02 * greatest(abs(a), CASE WHEN a = 0 THEN 1 ELSE 0 END) OR abs(c) > 0.02 * greatest(abs(d), CASE WHEN d = 0 THEN 1 ELSE 0 END) OR a <= 0 OR d <= 0 AS turned FROM w""",
    "boxes": f"""WITH q AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey + l_linenumber AS k FROM lineitem),
b AS (SELECT *, least({n_(3, 97)}, {n_(7, 97)}, {n_(13, 97)}) AS b0, least({n_(5, 89)}, {n_(11, 89)}, {n_(2, 89)}) AS b1, greatest({n_(3, 97)}, {n_(7, 97)}, {n_(13, 97)}) AS b2, greatest({n_(5, 89)}, {n_(11, 89)}, {n_(2, 89)}) AS b3,
  CASE WHEN k % 7 <> 0 THEN {n_(5, 40)} END AS o0, CASE WHEN k % 7 <> 0 THEN {n_(3, 40)} END AS o1, least({n_(17, 50)}, {n_(23, 50)}) AS r0, least({n_(19, 50)}, {n_(29, 50)}) AS r1, greatest({n_(17, 50)}, {n_(23, 50)}) AS r2, greatest({n_(19, 50)}, {n_(29, 50)}) AS r3 FROM q)
SELECT l_orderkey, l_linenumber, b0, b1, b2, b3, greatest(b0, coalesce(o0, b0)) AS c0, greatest(b1, coalesce(o1, b1)) AS c1, least(b2, coalesce(o0 + 30, b2)) AS c2, least(b3, coalesce(o1 + 30, b3)) AS c3, r0, r1, r2, r3,
  coalesce(o0 = b0 AND o1 = b1 AND o0 + 30 = b2 AND o1 + 30 = b3, false) AS same, CASE WHEN l_linenumber % 2 = 0 THEN least((b3 - b1) / 2, 6) ELSE 0.1 END::DOUBLE AS poke,
  least(0, k % 5 - 3)::DOUBLE - CASE WHEN b0 = r0 AND b1 = r1 AND b2 = r2 AND b3 = r3 THEN 2 ELSE 0 END AS grown FROM b""",
    "line_boxes": f"""WITH q AS (SELECT p_partkey, p_partkey AS k FROM part), v AS (SELECT *, {n_(3, 400)} AS x, {n_(7, 800)} AS y, {n_(11, 120)} AS width, {n_(5, 9)} + 6 AS size, {n_(1, 9, 4)} AS back,
  CASE WHEN k % 4 = 1 THEN CASE WHEN k % 2 = 1 THEN 12 ELSE 10 END ELSE abs(k % 4 - 1) END::DOUBLE AS run FROM q)
SELECT p_partkey, x AS l0, y + CASE WHEN k % 4 = 0 THEN -0.3::DOUBLE ELSE -0.22::DOUBLE END * size AS l1, x + greatest(width, 0.3::DOUBLE * size) AS l2, y + CASE WHEN k % 3 = 0 THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END * size AS l3,
  x AS q0, y - 0.25::DOUBLE * size AS q1, x + greatest(width, 0.3::DOUBLE * size) AS q2, y + 0.8::DOUBLE * size AS q3, least(x, x - back) AS s0, y - 0.25::DOUBLE * run AS s1, greatest(x, x - back) AS s2, y + 0.8::DOUBLE * run AS s3 FROM v""",
    "page_turns": f"""WITH q AS (SELECT p_partkey, p_partkey AS k, ((p_partkey % 5 * 90 - 90 + p_partkey % 3 * 90) % 360 + 360) % 360 AS rotation FROM part), v AS (SELECT *, {n_(1, 300)} + 300 AS w, {n_(1, 400)} + 400 AS h FROM q)
SELECT p_partkey, rotation::BIGINT AS rotation, CASE WHEN rotation % 180 = 90 THEN h ELSE w END AS sw, CASE WHEN rotation % 180 = 90 THEN w ELSE h END AS sh,
  CASE rotation WHEN 0 THEN 3 WHEN 90 THEN 5 WHEN 180 THEN -3 ELSE -5 END::DOUBLE AS dx, CASE rotation WHEN 0 THEN -5 WHEN 90 THEN 3 WHEN 180 THEN 5 ELSE -3 END::DOUBLE AS dy,
  CASE rotation WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END::DOUBLE AS m0, CASE rotation WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END::DOUBLE AS m1, CASE rotation WHEN 90 THEN -1 WHEN 270 THEN 1 ELSE 0 END::DOUBLE AS m2, CASE rotation WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END::DOUBLE AS m3,
  CASE WHEN rotation IN (90, 180) THEN w + 10 ELSE 10 END::DOUBLE AS m4, CASE WHEN rotation IN (180, 270) THEN h + 20 ELSE 20 END::DOUBLE AS m5, h - 40 AS cwx, 30.0::DOUBLE AS cwy, 40.0::DOUBLE AS ccwx, w - 30 AS ccwy FROM v""",
    "annotations": f"""WITH q AS (SELECT o_orderkey, o_orderkey AS k, [{', '.join(map(literal, KINDS))}][(o_orderkey % {len(KINDS)} + 1)::INT] AS kind FROM orders),
v AS (SELECT *, {n_(3, 300)} AS x1, {n_(5, 700)} AS y1, {n_(7, 300)} AS x2, {n_(11, 700)} AS y2, {n_(13, 200)} AS x, {n_(17, 600)} AS y, {n_(3, 90)} AS w, {n_(5, 70)} AS h, {n_(1, 4)} / 2 AS pad, k % {len(KINDS)} < 4 AS stroke, k % {len(KINDS)} BETWEEN 4 AND 6 AS shape FROM q),
b AS (SELECT *, CASE WHEN stroke THEN least(x1, x2) - pad ELSE x END AS b0, CASE WHEN stroke THEN least(y1, y2) - pad ELSE y END AS b1, CASE WHEN stroke THEN abs(x2 - x1) + 2 * pad ELSE w END AS b2, CASE WHEN stroke THEN abs(y2 - y1) + 2 * pad ELSE h END AS b3 FROM v)
SELECT o_orderkey, kind, b0, b1, b2, b3, 10 + b0 AS p0, 820 - (b1 + b3) AS p1, 10 + b0 + b2 AS p2, 820 - b1 AS p3,
  CASE WHEN stroke THEN 800 - greatest(y1, y2) - pad WHEN shape THEN 800 - (y + h) ELSE 800 - (y + h / 2) - w / 2 END AS u0, CASE WHEN stroke THEN least(x1, x2) - pad WHEN shape THEN x ELSE x + w / 2 - h / 2 END AS u1,
  CASE WHEN stroke THEN abs(y2 - y1) + 2 * pad WHEN shape THEN h ELSE w END AS u2, CASE WHEN stroke THEN abs(x2 - x1) + 2 * pad WHEN shape THEN w ELSE h END AS u3 FROM b""",
    "font_names": "WITH f(i, font, clean, normal, family, bold, italic, mono, serif, near, widths_of, far, legacy) AS (VALUES "
    + ", ".join("(" + ", ".join([str(i), literal(FONTS[i]), *map(literal, facts)]) + ")" for i, facts in enumerate(FONT_FACTS))
    + f""") SELECT p_partkey, f.* EXCLUDE (i), regexp_replace(far, '-.*', '') || '-' || CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND NOT mono THEN 'BoldItalic' WHEN p_partkey % 2 = 0 THEN 'Bold' WHEN p_partkey % 3 = 0 AND NOT mono THEN 'Italic' ELSE 'Regular' END AS restyled
FROM part JOIN f ON p_partkey % {len(FONTS)} = i""",
    "number_forms": f"""WITH q AS (SELECT *, p_partkey AS k FROM part), v AS (SELECT *, ({n_(7919, 200_003, 100_000)}) / 32000 AS v, substr(lower(to_hex(k * 7919)), 1, 3) AS h FROM q),
r AS (SELECT *, floor(v * 10000 + 0.5::DOUBLE)::BIGINT AS r, {', '.join(f"floor((1 - {n_(a, 101)} / 100) * (1 - {n_(13, 101)} / 100) * 255 + 0.5::DOUBLE)::INT AS {c}" for a, c in ((3, 'cc'), (7, 'mm'), (11, 'yy')))} FROM v)
SELECT p_partkey, v, regexp_replace(CASE WHEN r < 0 THEN '-' ELSE '' END || (abs(r) // 10000) || '.' || lpad((abs(r) % 10000)::VARCHAR, 4, '0'), '[.]?0*$', '') AS said, '#' || lpad(lower(to_hex(cc)), 2, '0') || lpad(lower(to_hex(mm)), 2, '0') || lpad(lower(to_hex(yy)), 2, '0') AS cmyk,
  CASE WHEN length(h) = 3 THEN ('0x' || h[1] || h[1] || h[2] || h[2] || h[3] || h[3])::BIGINT ELSE ('0x' || h)::BIGINT END AS rgb, '#' || h AS short, '<' || lower(hex(p_brand::BLOB)) || '>' AS bytes, p_name || ' a_b_c' AS base FROM r""",
}
