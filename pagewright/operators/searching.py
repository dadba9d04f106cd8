"""Search and replacement over many files in full: what can't be replaced and why, pages that can't be searched, and what became of each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.text import find_text

#: What a hit's line says: it can't be edited (its own reason), or its copied text isn't sure and nobody has checked it.
UNCHECKED = "unchecked"
#: Why a hit isn't replaced, besides that.
PAGE_GONE, LINE_GONE, CHANGED = "page gone", "line gone", "changed since the search"


def hits(lines: DataFrame, pattern: str) -> DataFrame:
    """The hits in lines (file, page, line, text, reason, verify, verified), with editable and reason: the line's own, or that it has to be checked first. Null texts have none; no shuffle."""
    found = find_text(lines, pattern)
    reason = F.coalesce("reason", F.when(F.coalesce(F.col("verify"), F.lit(False)) & ~F.coalesce(F.col("verified"), F.lit(False)), UNCHECKED))
    return found.withColumn("reason", reason).withColumn("editable", F.col("reason").isNull()).drop("verify", "verified")


def notes(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, page, note) of pages (file, page, source, refusal) that can't be searched: they have a source but no lines, and say why; without a reason there is nothing to say."""
    with_lines = lines.select("file", "page").distinct()
    return pages.where(F.col("source") & F.col("refusal").isNotNull()).join(with_lines, ["file", "page"], "left_anti").select("file", "page", F.col("refusal").alias("note"))


def summary(found: DataFrame, said: DataFrame, files: DataFrame) -> DataFrame:
    """(file, n_hits, n_blocked, n_notes, shown) of each file: shown if it has hits or notes. Hits are counted where they are."""
    counted = found.groupBy("file").agg(F.count("*").alias("n_hits"), F.count_if(~F.col("editable")).alias("n_blocked"))
    noted = said.groupBy("file").agg(F.count("*").alias("n_notes"))
    out = files.select("file").join(counted, "file", "left").join(noted, "file", "left").na.fill(0, ["n_hits", "n_blocked", "n_notes"])
    return out.withColumn("shown", (F.col("n_hits") > 0) | (F.col("n_notes") > 0))


def rewritten(text: Column, spans: Column, replacement: str) -> Column:
    """The text with spans (start, end; apart and in order) replaced; if by nothing, from the right, leaving no double space: a space after a span goes if one is before it or the line starts there, else a space before it if the line ends or punctuation follows."""
    start = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    gap = lambda i: F.substring(text, start(i) + 1, F.coalesce(F.get(spans, i)["start"], F.length(text)) - start(i))
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), gap)
    if replacement:
        return F.array_join(gaps, replacement)

    def drop(rest: Column, g: Column) -> Column:
        before, first = g["g"], g["i"] == 0
        kept = F.when(rest.startswith(" ") & ((before == "") & first | before.endswith(" ")), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
        shorter = F.when((kept == rest) & before.endswith(" ") & ((rest == "") | rest.rlike(r"^[\s.,;:!?)]")), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
        return F.concat(shorter, kept)

    left = F.reverse(F.transform(F.slice(gaps, F.lit(1), F.size(spans)), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.aggregate(left, F.element_at(gaps, -1), drop)


def replaced(found: DataFrame, pages: DataFrame, lines: DataFrame, replacement: str) -> tuple[DataFrame, DataFrame]:
    """What becomes of the hits that were picked (hits() with `picked`): their statuses (file, page, line, hit_no, ok, message), and the rewritten lines (file, page, line, new_text).

    pages (file, page) and lines (file, page, line, text) are those of now. A line is rewritten once, from its picked hits;
    it isn't if its page or the line has gone, if one of the hits can't be replaced (all get its reason), or if its text
    isn't that of the search. A line's hits are one row before they meet anything.
    """
    key = ["file", "page", "line"]
    span = F.struct("start", "end", "hit_no", "reason")
    of = found.where("picked").groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans"), F.first("text").alias("was"))
    here = pages.select("file", "page").distinct().withColumn("_page", F.lit(True))
    now = lines.select(*key, F.col("text").alias("now"), F.lit(True).alias("_line"))
    met = of.join(here, ["file", "page"], "left").join(now, key, "left")
    blocked = F.get(F.filter(F.transform("spans", lambda s: s["reason"]), lambda r: r.isNotNull()), F.lit(0))
    message = F.when(F.col("_page").isNull(), PAGE_GONE).when(blocked.isNotNull(), blocked).when(F.col("_line").isNull(), LINE_GONE).when(~F.col("now").eqNullSafe(F.col("was")), CHANGED)
    met = met.withColumn("message", message).withColumn("new_text", F.when(message.isNull(), rewritten(F.col("now"), F.col("spans"), replacement)))
    statuses = met.select(*key, F.explode("spans.hit_no").alias("hit_no"), F.col("message").isNull().alias("ok"), "message")
    return statuses, met.where("message is null").select(*key, "new_text")


def file_statuses(found: DataFrame, statuses: DataFrame) -> DataFrame:
    """(file, n_ok, n_failed, n_open): hits replaced, hits that couldn't be, and hits that may still be picked."""
    done = statuses.groupBy("file").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    editable = found.groupBy("file").agg(F.count_if("editable").alias("n_editable"))
    return editable.join(done, "file", "left").na.fill(0, ["n_ok", "n_failed"]).select("file", "n_ok", "n_failed", (F.col("n_editable") - F.col("n_ok")).alias("n_open"))
