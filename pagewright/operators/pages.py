"""Page order, groups of pages, edit logs and object graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import A4, display_size, total_rotation
from pagewright.functions.scalars import js_round
from pagewright.session import cut, tasks_of


def reordered(pages: DataFrame, from_: int, to: int, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """pages with new_at: the page at from_ moves to `to`, those between make room. Groups in which either isn't a page stay as they are."""
    n = F.max(at).over(Window.partitionBy(by))
    place = F.col(at)
    moved = F.when(place == from_, to)
    moved = moved.when((place > from_) & (place <= to), place - 1) if from_ < to else moved.when((place >= to) & (place < from_), place + 1)
    return pages.withColumn("new_at", F.when((n < max(from_, to)) | F.lit(min(from_, to) < 0), place).otherwise(moved.otherwise(place)).cast("long"))


def every_n(pages: DataFrame, k: int, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """(by, part, label, n_pages): parts of k pages with a label such as 3-4."""
    parts = pages.groupBy(by, F.floor(F.col(at) / k).alias("part")).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n_pages"))
    label = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("a") + 1, F.col("b") + 1))
    return parts.select(by, "part", label.alias("label"), "n_pages")


def current_lines(edits: DataFrame) -> DataFrame:
    """The last edit of each line of an edit log (doc, line, version, value). Partial aggregates, no sort of the log."""
    return edits.groupBy("doc", "line").agg(F.max(F.struct("version", "value")).alias("e"), F.count("*").alias("n_edits")).select("doc", "line", F.col("e.version").alias("version"), F.col("e.value").alias("value"), "n_edits")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids that the roots reach along edges (a, b), cycles or not: a frontier joined round by round against what was seen, with a reliable checkpoint each round."""
    seen = front = cut(roots.select("id").distinct())
    while not front.isEmpty():
        front = cut(edges.join(front, edges["a"] == front["id"], "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = cut(seen.union(front))
    return seen


def without_page(pages: DataFrame, i: int, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """pages without page i, with new_at; a group's only page stays."""
    several = F.col("_n") > 1
    counted = pages.withColumn("_n", F.count("*").over(Window.partitionBy(by))).where(~several | (F.col(at) != i))
    return counted.withColumn("new_at", F.when(several & (F.col(at) > i), F.col(at) - 1).otherwise(F.col(at))).drop("_n")


def with_copy(pages: DataFrame, i: int, at: str = "turn") -> DataFrame:
    """pages with a copy of page i after it: is_copy and new_at. No shuffle."""
    out = pages.withColumn("is_copy", F.explode(F.when(F.col(at) == i, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return out.withColumn("new_at", F.col(at) + (F.col("is_copy") | (F.col(at) > i)).cast("int"))


def appended(pages: DataFrame, more: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """The pages of both tables, those of `more` after the last page of the same group, with new_at."""
    last = pages.groupBy(by).agg((F.max(at) + 1).alias("_first"))
    moved = more.join(last, by, "left").withColumn("new_at", F.col(at) + F.coalesce("_first", F.lit(0))).drop("_first")
    return pages.withColumn("new_at", F.col(at)).unionByName(moved)


def with_blank(pages: DataFrame, after: int, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """pages (w, h, base_rot, rot) with new_at and is_blank: an empty page after page `after`, as large as that one is displayed; A4 if there is none. In a shorter document it comes last."""
    seen = display_size(F.col("w"), F.col("h"), total_rotation(F.col("base_rot"), F.col("rot")))
    like = pages.where(F.col(at) == after).select(by, seen.alias("_s"))
    blank = pages.groupBy(by).agg((F.max(at) + 1).alias("_n")).join(like, by, "left").select(by, F.lit(None).cast(dict(pages.dtypes)[at]).alias(at), F.coalesce(F.get("_s", F.lit(0)), F.lit(A4[0])).alias("w"), F.coalesce(F.get("_s", F.lit(1)), F.lit(A4[1])).alias("h"), F.lit(0).alias("base_rot"), F.lit(0).alias("rot"), F.least(F.lit(after + 1), F.col("_n")).cast("long").alias("new_at"), F.lit(True).alias("is_blank"))
    moved = pages.select(by, at, "w", "h", "base_rot", "rot", (F.col(at) + (F.col(at) > after).cast("int")).cast("long").alias("new_at"), F.lit(False).alias("is_blank"))
    return moved.unionByName(blank)


def split_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, part, page_at, target_at, link) of links (doc, link, page, target) in parts (doc, part, at, page): links whose target is in the same part point to its first place there, others go."""
    first = groups.groupBy("doc", "part", F.col("page").alias("target")).agg(F.min("at").alias("target_at"))
    placed = groups.select("doc", "part", F.col("at").alias("page_at"), "page").join(links, ["doc", "page"])
    return placed.join(first, ["doc", "part", "target"]).select("doc", "part", "page_at", "target_at", "link")


def extracted(groups: Column) -> Column:
    """The pages of all groups, each once, in order."""
    return F.array_distinct(F.flatten(groups))


def archive_names(files: DataFrame) -> DataFrame:
    """files (archive, at, name) with `stored`: a name that was used before, in any case, gets the number of its use before its ending."""
    n = F.row_number().over(Window.partitionBy("archive", F.lower("name")).orderBy("at"))
    ending = F.regexp_extract("name", r"(\.[^./]*)$", 1)
    stem = F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(ending))
    return files.withColumn("_n", n).withColumn("stored", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ending))).drop("_n")


def current_text(lines: DataFrame, edits: DataFrame, dropped: DataFrame, incoming: DataFrame) -> DataFrame:
    """The lines of pages as they are now: (page, id, text, x, y, width, state).

    lines (page, id, text, x, y, width, shift); the last edit of a line (page, id, version, kind, text, dx, dy, new_width;
    kind text, move or insert) moves or replaces it, lines without one move by their shift; dropped (page, id) go;
    inserted lines and those that flow in (page, id, text, x, y, width, dx, dy) come.
    """
    # edits are grouped by sorting and lines sorted to meet them: both are dealt first, over as many tasks
    tasks = tasks_of(lines)
    lines, edits = lines.repartition(tasks, "page", "id"), edits.repartition(tasks, "page", "id")
    last = edits.groupBy("page", "id").agg(F.max_by(F.struct("kind", "text", "dx", "dy", "new_width", "x", "y"), "version").alias("e"))
    e = lambda n: F.col(f"e.{n}")
    kept = lines.join(dropped, ["page", "id"], "left_anti").join(last.where("e.kind <> 'insert'"), ["page", "id"], "left")
    edited = F.col("e").isNotNull()
    own = kept.select(
        "page", F.col("id").cast("string").alias("id"), F.when(edited, F.coalesce(e("text"), "text")).otherwise(F.col("text")).alias("text"), (F.col("x") + F.when(edited, F.coalesce(e("dx"), F.lit(0.0))).otherwise(0.0)).alias("x"),
        (F.col("y") + F.when(edited, F.coalesce(e("dy"), F.lit(0.0))).otherwise(F.col("shift"))).alias("y"), F.when(e("kind") == "text", F.greatest(F.lit(1.0), F.coalesce(e("new_width"), "width"))).otherwise(F.col("width")).alias("width"),
        F.when(edited, e("kind")).otherwise("kept").alias("state"),
    )
    new = last.where("e.kind = 'insert'").select("page", F.col("id").cast("string").alias("id"), e("text").alias("text"), (e("x") + F.coalesce(e("dx"), F.lit(0.0))).alias("x"), (e("y") + F.coalesce(e("dy"), F.lit(0.0))).alias("y"), F.coalesce(e("new_width"), F.lit(0.0)).alias("width"), F.lit("inserted").alias("state"))
    flowed = incoming.select("page", F.concat(F.lit("flow:"), F.col("id").cast("string")).alias("id"), "text", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "width", F.lit("flowed").alias("state"))
    return own.unionByName(new).unionByName(flowed)


def moves(log: DataFrame) -> DataFrame:
    """(page, id, dx, dy, n) of a log of steps (page, id, version, dx, dy): their sum to a thousandth; lines that are back where they were are left out."""
    total = log.groupBy("page", "id").agg((js_round(F.sum("dx") * 1000) / 1000).alias("dx"), (js_round(F.sum("dy") * 1000) / 1000).alias("dy"), F.count("*").alias("n"))
    return total.where((F.abs("dx") >= 1e-3) | (F.abs("dy") >= 1e-3))


def after_undo(log: DataFrame, most: int = 150) -> DataFrame:
    """(doc, version, value): the state of each document after a log (doc, version, kind, value) of commits, undos and redos; kind commit, undo or redo. `most` steps can be undone.

    A document's log is one group that streams through in order; what is kept is the two stacks, `most` states each.
    """
    kind = dict(log.dtypes)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, now, past, future = None, None, [], []
        for pdf in batches:
            done = []
            for d, version, what, value in zip(*(pdf[c].tolist() for c in ("doc", "version", "kind", "value")), strict=True):
                if d != doc:
                    if now is not None:
                        done.append((doc, *now))
                    doc, now, past, future = d, (None, None), [], []
                if what == "undo" and past:
                    future.append(now)
                    now = past.pop()
                elif what == "redo" and future:
                    past.append(now)
                    now = future.pop()
                elif what == "commit":
                    past = [*past[-most + 1 :], now]
                    now, future = (version, value), []
            yield pd.DataFrame(done, columns=["doc", "version", "value"]).astype({"version": "Int64"})
        if now is not None:
            yield pd.DataFrame([(doc, *now)], columns=["doc", "version", "value"]).astype({"version": "Int64"})

    ordered = log.repartition("doc").sortWithinPartitions("doc", "version").select("doc", "version", "kind", "value")
    return ordered.mapInPandas(replay, f"doc {kind['doc']}, version long, value {kind['value']}")


def verified_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(page, id, has_new, old_gone) of edits (page, id, old, new) against pages (page, before, after): all text of a page without spaces.

    The new text must be there, and the old one as often as before less this edit and others of the same text, plus as
    often as the new texts hold it.
    """
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    # plain text, not an expression: what goes with all uses of the needle, in lengths of it
    times = lambda hay, needle: F.when(needle == "", 0).otherwise(((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("int"))
    e = edits.select("page", "id", bare("old").alias("old"), bare("new").alias("new"))
    same = Window.partitionBy("page", "old")
    news = e.groupBy("page").agg(F.array_join(F.collect_list("new"), "\u0001").alias("news"))
    e = e.withColumn("others", F.count("*").over(same) - 1).join(news, "page").join(pages, "page")
    allowed = F.greatest(F.lit(0), times(F.col("before"), F.col("old")) - 1 - F.col("others")) + times(F.col("news"), F.col("old"))
    return e.select("page", "id", ((F.col("new") == "") | F.contains("after", "new")).alias("has_new"), ((F.col("old") == "") | (times(F.col("after"), F.col("old")) <= allowed)).alias("old_gone"))


def edits_key(edits: DataFrame) -> DataFrame:
    """(page, key): a digest of a page's edits in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("version", "id", "text")))
    return edits.groupBy("page").agg(F.sha2(F.array_join(F.transform(ordered, lambda e: F.concat_ws("\u0001", e["version"].cast("string"), e["id"].cast("string"), e["text"])), "\u0002"), 256).alias("key"))


def untouched(pages: DataFrame) -> DataFrame:
    """(doc, untouched) of pages (doc, at, src, page, n_source, rot, n_changes): all of one source, in its order, unturned and unchanged."""
    whole = (F.count("*") == F.max("n_source")) & (F.min("src") == F.max("src")) & (F.count("src") == F.count("*"))
    each = F.bool_and((F.col("page") == F.col("at")) & (F.pmod("rot", F.lit(360)) == 0) & (F.col("n_changes") == 0))
    return pages.groupBy("doc").agg(F.coalesce(whole & each, F.lit(False)).alias("untouched"))
