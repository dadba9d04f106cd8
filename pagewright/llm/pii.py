"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, row_key

#: Fixed values of the contract, each with possessive quantifiers (no way back into a match, no recursion on long runs).
#: An e-mail starts where a run of local characters starts or where the last match ended: from within the run it would
#: reach the same @.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?:[0-9A-Z]{11,30}|(?:\x20[0-9A-Z]{4}){2,7}(?:\x20[0-9A-Z]{1,3})?)",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words near a span that make it likelier, and the score without and with them, in hundredths.
CONTEXT = {
    "email": ("mail|e-mail|email|contact|write|schreib|schreiben|correo|courriel", 90, 99),
    "ip": ("host|server|ip|address|login", 50, 80),
    "card": ("card|visa|master|mastercard|credit|karte|carte|tarjeta", 70, 95),
    "phone": ("phone|call|tel|fax|mobil|mobile", 60, 90),
    "iban": ("iban|bank|account|konto|compte|cuenta", 80, 99),
    "secret": ("token|secret|password|passwd|pwd|passphrase|credential|credentials|apikey|api_key|key|bearer|auth|authorization", 30, 95),
}
#: Forms of secrets that say what they are; they score SECRET_FORM without a word near them.
SECRET_FORMS, SECRET_FORM = "^(AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|glpat-[0-9A-Za-z_-]{20}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})$", 90
#: The least score of a kind that isn't in BASE, and how many different characters a secret has at least.
LEAST, SECRET_CHARS = 50, 10
NEAR = 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod_97(iban: Column) -> Column:
    """The remainder of an IBAN by 97: its first four characters go to the end, letters count as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97))


def is_iban(packed: Column) -> Column:
    fits = F.length(packed).between(15, 34)
    return fits & (F.when(fits, mod_97(packed)).otherwise(0) == 1)


def iban_part(match: Column) -> Column:
    """The most leading groups of an IBAN written in groups that pass mod 97: a group of four that follows it looks like one of its own. The whole if none pass."""
    groups = F.split(match, " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.when(match.contains(" "), F.coalesce(F.get(F.filter(parts, lambda p: is_iban(F.replace(p, F.lit(" "), F.lit("")))), F.lit(0)), match)).otherwise(match)


def confirmed(kind: Column, match: Column) -> Column:
    octets, packed = F.split(match, r"\."), F.regexp_replace(match, " ", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(octets, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(octets, lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
        .when(kind == "card", F.length(digits(match)).between(16, 19) & F.call_function("luhn_check", F.when(F.length(digits(match)).between(16, 19), digits(match)).otherwise("0")))
        .when(kind == "phone", F.length(digits(match)).between(8, 15))
        .when(kind == "iban", is_iban(packed))
        .otherwise((F.length(match) <= 512) & match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= SECRET_CHARS))
    )


def pii_spans(docs: DataFrame) -> DataFrame:
    """Spans of docs (doc_id, text): doc_id, _k1, _k2, kind, number, start, end (code points, end exclusive), match, score (hundredths).

    A document without spans has one row with a null kind. Start and end come from running sums, per document and kind,
    over the lengths of the matches and of the gaps between them; only matches and 40 characters beside them move,
    never the text. Kinds are scanned apart, so spans of different kinds may overlap.

    Base kinds are kept as the contract has them, whatever their score. IBANs (grouped by spaces or not, no letter or
    digit beside them, mod 97; of a grouped one the leading groups that pass) and secrets (runs of 20 characters or more of letters, digits, - and _ with both and
    with SECRET_CHARS different ones) are added where forms and context words give them LEAST or more.

    Null and empty texts have no spans; a null doc_id is kept; rows equal in id and text count as one; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", *row_key(), text.alias("text"))
    rows = rows.select("*", *[
        (F.when(F.contains("text", F.lit(NEEDS[k])), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) if k in NEEDS else F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}")
        for k, p in PATTERNS.items()
    ])
    rows = rows.select("doc_id", "_k1", "_k2", *[f"m_{k}" for k in PATTERNS], *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()])

    def proposals(number: int, kind: str) -> Column:
        gap = lambda i: F.get(f"g_{kind}", i)
        return F.transform(f"m_{kind}", lambda m, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(number).alias("number"), i.alias("at"), m.alias("match"), F.length(gap(i)).cast("long").alias("gap"),
            F.right(gap(i), F.lit(NEAR)).alias("before"), F.left(gap(i + 1), F.lit(NEAR)).alias("after"),
        ))

    rows = rows.select("doc_id", "_k1", "_k2", F.explode_outer(F.flatten(F.array(*[proposals(n, k) for n, k in enumerate(PATTERNS)]))).alias("p")).select("doc_id", "_k1", "_k2", "p.*")
    rows = rows.dropDuplicates(["_k1", "_k2", "kind", "at"]).repartition("_k1", "_k2")  # repeated rows are one before they move
    upto = Window.partitionBy("_k1", "_k2", "kind").orderBy("at")
    size = F.length("match").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    rows = rows.withColumn("whole", F.col("match")).withColumn("match", F.when(F.col("kind") == "iban", iban_part(F.col("match"))).otherwise(F.col("match")))
    rows = rows.withColumn("after", F.concat(F.substring(F.col("whole"), F.length("match") + 1, F.length("whole")), "after")).withColumn("end", F.col("start") + size)
    near = ascii_lower(F.concat_ws(" ", "before", "after"))
    score = F.lit(None).cast("int")
    for kind, (words, without, with_) in CONTEXT.items():
        alone = F.when(F.col("match").rlike(SECRET_FORMS), SECRET_FORM).otherwise(without) if kind == "secret" else without
        score = F.when(F.col("kind") == kind, F.when(near.rlike(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"), with_).otherwise(alone)).otherwise(score)
    added = (score >= LEAST) & ~F.concat(F.right("before", F.lit(1)), F.left("after", F.lit(1))).rlike("[0-9A-Za-z]")
    rows = rows.withColumn("ok", F.col("kind").isNotNull() & confirmed(F.col("kind"), F.col("match")) & (F.col("kind").isin(*BASE) | added)).withColumn("score", score)
    return rows.select("doc_id", "_k1", "_k2", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("kind", "number", "start", "end", "match", "score")])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    spans = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    span = F.when(F.col("kind").isNotNull(), F.struct("number", "start", F.concat_ws(":", "kind", "start", "end").alias("said"), "score", F.col("kind").isin(*BASE).alias("base")))
    docs = spans.groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["number"] == list(PATTERNS).index(kind))).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    return docs.select(
        "doc_id", *[n(k) for k in BASE], F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"), n("iban"), n("secret"), F.size("spans").cast("long").alias("n_spans"),
    )


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z][A-Z][0-9][0-9](?:[0-9A-Z]{11,30}|(?:\x20[0-9A-Z]{4}){2,7}(?:\x20[0-9A-Z]{1,3})?)", "secret": r"[A-Za-z0-9_-]{20,}",
    }
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {n} AS number, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g, '{CONTEXT[k][0]}' AS words, {CONTEXT[k][1]} AS without, {CONTEXT[k][2]} AS with_ FROM texts"
        for n, (k, p) in enumerate(plain.items())
    )
    passes = lambda p: f"length({p}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, [({value})::BIGINT FOR c IN string_split({p}[5:] || {p}[:4], '')]), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    value = "CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS ({kinds}),
each AS (SELECT doc_id, kind, number, words, without, with_, unnest(m) AS match, generate_subscripts(m, 1) AS i, g FROM kinds WHERE len(m) > 0),
found AS (SELECT *, sum(length(g[i]) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT - length(match) AS start FROM each),
parts AS (SELECT doc_id, i, max(length(p)) AS n FROM (SELECT doc_id, i, p, replace(p, ' ', '') AS packed FROM (SELECT doc_id, i, array_to_string(string_split(match, ' ')[:k], ' ') AS p FROM (SELECT doc_id, i, match, unnest(range(1, len(string_split(match, ' ')) + 1)) AS k FROM each WHERE kind = 'iban' AND contains(match, ' ')))) WHERE {passes("packed")} GROUP BY ALL),
cut AS (SELECT f.* EXCLUDE (match), coalesce(left(match, n), match) AS match, substr(match, coalesce(n, length(match))::BIGINT + 1) || g[f.i + 1] AS after FROM found f LEFT JOIN parts p ON f.kind = 'iban' AND p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.i = f.i),
placed AS (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS d, replace(match, ' ', '') AS packed, start + length(match) AS stop FROM cut),
tested AS (SELECT *,
  CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_max([try_cast(p AS DOUBLE) FOR p IN string_split(match, '.')]) <= 255
    WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN d[length(d) + 1 - j]::INT ELSE CASE WHEN d[length(d) + 1 - j]::INT > 4 THEN 2 * d[length(d) + 1 - j]::INT - 9 ELSE 2 * d[length(d) + 1 - j]::INT END END FOR j IN range(1, length(d) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 8 AND 15
    WHEN 'secret' THEN length(match) <= 512 AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND len(list_distinct(string_split(match, ''))) >= {SECRET_CHARS}
    ELSE {passes("packed")} END AS ok,
  CASE WHEN regexp_matches(translate(right(g[i], 40) || ' ' || left(after, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])(' || words || ')([^a-z0-9]|$)') THEN with_
    WHEN kind = 'secret' AND regexp_matches(match, '{SECRET_FORMS}') THEN {SECRET_FORM} ELSE without END AS score FROM placed),
spans AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM tested WHERE ok AND (kind NOT IN ('iban', 'secret') OR score >= {LEAST} AND NOT regexp_matches(right(g[i], 1) || left(after, 1), '[0-9A-Za-z]'))),
docs AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'secret') AS n_secret, count(*) AS n_spans,
  string_agg(said, ',' ORDER BY number, start) FILTER (kind NOT IN ('iban', 'secret')) AS base, string_agg(said, ',' ORDER BY number, start) AS spans, string_agg(score::VARCHAR, ',' ORDER BY number, start) AS scores FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_secret, 0) AS n_secret, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM texts t LEFT JOIN docs d ON t.doc_id IS NOT DISTINCT FROM d.doc_id
"""


OP7_SQL = _sql()
