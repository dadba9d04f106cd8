"""Lines, search, replacement and fields of many documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import let, mask_digits, running
from pagewright.session import join_spread

# Patterns of contact fields, and code points around a hit in its snippet.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PHONE = r"\+?\(?[0-9][0-9 \t().-]{8,}[0-9]"
AROUND = 28

#: Documents of a block in which running lines are compared.
BLOCK = 1000


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, text) of every line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))


def find_pattern(query: str, whole_word: bool = False, match_case: bool = False) -> str | None:
    """The regular expression of a search; None for an empty query."""
    if not query:
        return None
    src = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", query)
    if whole_word:
        src = rf"(?<![\p{{L}}\p{{N}}_]){src}(?![\p{{L}}\p{{N}}_])"
    return src if match_case else f"(?iu){src}"


def find_text(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """A row for each hit: hit_no from 0, start and end in code points (end exclusive), the hit and a snippet. No shuffle: a line's hits are told from the gaps between them by running sums."""
    found = rows.select("*", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_m")).where(F.size("_m") > 0)
    found = found.select("*", F.split(text, pattern, -1).alias("_g"))
    ends = running(F.zip_with("_m", F.slice("_g", 1, F.size("_m")), lambda m, g: F.length(g) + F.length(m)), F.lit(0), lambda at, n: at + n)
    found = found.select(*rows.columns, F.posexplode(F.arrays_zip(F.col("_m").alias("hit"), ends.alias("end"))).alias("hit_no", "_h"))
    out = found.select(*rows.columns, "hit_no", (F.col("_h.end") - F.length("_h.hit")).alias("start"), "_h.hit", "_h.end")
    first, last = F.greatest(F.lit(0), F.col("start") - AROUND), F.least(F.length(text), F.col("end") + AROUND)
    snippet = F.concat(F.when(first > 0, "…").otherwise(""), F.substring(F.col(text), first + 1, last - first), F.when(last < F.length(text), "…").otherwise(""))
    return out.withColumn("snippet", snippet)


def replace_text(rows: DataFrame, pattern: str, replacement: str, text: str = "text") -> DataFrame:
    """rows with the hits replaced and their number; the replacement is plain text."""
    n = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")
    return rows.withColumn("n_hits", n).withColumn("replaced", F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", replacement)))


def delete_hits(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """rows with the hits deleted from right to left, without leaving a double space: a space after a hit goes if one is before it or the line starts there; else a space before it goes if the line ends or punctuation follows."""

    def joined(g: Column) -> Column:
        def drop(rest: Column, i: Column) -> Column:
            before = F.get(g, i - 1)
            kept = F.when(rest.startswith(" ") & ((before == "") & (i == 1) | before.endswith(" ")), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
            shortened = F.when((kept == rest) & before.endswith(" ") & ((rest == "") | rest.rlike(r"^[\s.,;:!?)]")), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
            return F.concat(shortened, kept)

        return F.when(F.size(g) > 1, F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(g) - 1)), F.element_at(g, -1), drop)).otherwise(F.col(text))

    # the line is split once, also where a filter of what is deleted is computed before it: not once for each hit
    return rows.withColumn("deleted", let(F.split(text, pattern, -1), joined))


def contact_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, email, phone): the first of each in a document, null if there is none."""
    first = lambda p: F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
    return docs.select("doc_id", first(EMAIL).alias("email"), first(PHONE).alias("phone"))


def running_lines(rows: DataFrame) -> DataFrame:
    """Lines whose text, with numbers masked, also stands in the document before or after: (doc_id, line_no, norm).

    Texts meet by 128 bits of hash, in blocks of BLOCK documents that also see the last document before and the first
    after them: a line that stands in every document is dealt over all blocks, and a line's text moves once.
    """
    masked = rows.select("doc_id", "line_no", mask_digits(F.col("text")).alias("norm")).where("norm <> ''")
    at = F.floor(F.col("doc_id") / BLOCK)
    others = F.array(F.when(F.pmod("doc_id", F.lit(BLOCK)) == 0, at - 1), F.when(F.pmod("doc_id", F.lit(BLOCK)) == BLOCK - 1, at + 1))
    seen = masked.select("*", F.xxhash64(F.lit("a"), "norm").alias("h1"), F.xxhash64(F.lit("b"), "norm").alias("h2"), at.alias("home"), F.explode(F.array_compact(F.concat(F.array(at), others))).alias("block"))
    same = Window.partitionBy("h1", "h2", "block").orderBy("doc_id")
    near = (F.count("*").over(same.rangeBetween(-1, -1)) > 0) | (F.count("*").over(same.rangeBetween(1, 1)) > 0)
    return seen.withColumn("near", near).where("near and home = block").select("doc_id", "line_no", "norm")


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id, is_copy): equal contents point to the smallest id. Contents are compared by SHA-256; a hot content is one row per task before it is counted, and its documents are dealt over many tasks to meet it."""
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    met = join_spread(keyed, first, ["key"], "n", docs.count(), F.xxhash64("doc_id"))
    return met.select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_copy"))


def normal_links(pages: DataFrame) -> DataFrame:
    """(page_id, link, kind): the address without scheme, www., fragment and closing slash, in lower case."""
    link = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), "#.*$", ""), "/+$", ""))
    kind = F.when(link.rlike(r"^([a-z]+\.)?linkedin\.com/in/"), "linkedin").when(link.startswith("github.com/"), "github").otherwise("other")
    return pages.select("page_id", link.alias("link"), kind.alias("kind"))
