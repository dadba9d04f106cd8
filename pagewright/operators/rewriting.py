"""Content streams rewritten: items moved or dropped by replacing spans of the stream."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import at, number_text, user_delta
from pagewright.operators.graphics import followed, listed_items, operands
from pagewright.operators.painted import SHORT, operations
from pagewright.operators.streams import listed

#: Replacements (page, s, e, text, inserts): the span from s to e gives way to the text; inserts: it only adds text.
SPAN = ("page", "s", "e", "text", "inserts")
#: How many points an operator names that is written anew; the largest whole number; characters that a task keeps for streams that come again.
POINTS, MOST, KEPT = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2}, 2**63 - 1, 1 << 24


def spliced(stream: str, spans: Sequence[dict]) -> tuple[str, int]:
    """A stream after spans in order from the right, and how many of them are kept: one that ends where the last kept one begins, or before."""
    pieces, upto = [], len(stream)
    start, kept = 2**31 - 1, 0
    for r in spans:
        if r["e"] <= start:
            start, kept = r["s"], kept + 1
            pieces += [stream[r["e"] : upto], r["text"]]
            upto = r["s"]
    return "".join([stream[:upto], *reversed(pieces)]), kept


def rewritten(streams: DataFrame, spans: DataFrame) -> DataFrame:
    """(page, stream, n_kept, n_dropped) of streams (page, stream) after SPANs: those that run into a kept one further right are dropped.

    What is kept is told from the right, a page's spans in a row. Streams without spans stay; spans of pages without a
    stream are left out.
    """
    span = F.struct((-F.col("s")).alias("k"), F.col("inserts"), F.col("at"), F.col("s"), F.col("e"), F.col("text"))
    numbered = spans.withColumn("at", F.xxhash64("s", "e", "text"))
    of = numbered.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(span)), lambda r: F.struct(r["s"].cast("int").alias("s"), r["e"].cast("int").alias("e"), r["text"].alias("text"))).alias("spans"))
    kind = dict(streams.dtypes)["page"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [(t, 0) if not s or t is None else spliced(t, s) for t, s in zip(texts, found, strict=True)]
            dropped = [len(s or ()) - n for (_, n), s in zip(out, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32()), pa.array(dropped, pa.int32())], ["page", "stream", "n_kept", "n_dropped"])

    return streams.select("page", "stream").join(of, "page", "left").mapInArrow(told, f"page {kind}, stream string, n_kept int, n_dropped int")


def moved_operator(op: Column, v: Column, dx: Column, dy: Column) -> Column:
    """A path's operator with its points moved; null for others."""
    p = lambda i: [number_text(at(v, i) + dx), number_text(at(v, i + 1) + dy)]
    said = lambda parts, name: F.concat_ws(" ", *parts, name)
    out = F.when(op.isin("m", "l"), said(p(0), op)).when(op == "c", said([*p(0), *p(2), *p(4)], op)).when(op.isin("v", "y"), said([*p(0), *p(2)], op))
    return out.when(op == "re", said([*p(0), number_text(at(v, 2)), number_text(at(v, 3))], op))


def shifts(items: DataFrame, operations: DataFrame, streams: DataFrame) -> DataFrame:
    """SPANs that move items (page_items with dy) by dy up the page: a path's points are written anew, operator by operator; images and forms, inline or not, are wrapped in a moved space. Items without dy, shadings and texts stay, as do those whose space can't be undone."""
    moving = items.where((F.coalesce("dy", F.lit(0.0)) != 0) & ~F.col("kind").isin("shading", "text")).withColumn("d", user_delta(F.col("ctm"), F.lit(0.0), F.col("dy"))).where("d is not null")
    v = F.transform(F.array(*[F.get("args", F.lit(i)) for i in range(6)]), lambda a: F.coalesce(a.try_cast("double"), F.lit(0.0)))
    places = moving.where("kind = 'path'").select("page", "d", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("i"))
    text = moved_operator(F.col("op"), v, at(F.col("d"), 0), at(F.col("d"), 1))
    paths = places.join(operations, ["page", "i"]).select("page", F.col("start").alias("s"), F.col("end").alias("e"), text.alias("text"), F.lit(False).alias("inserts")).where("text is not null")
    step = F.concat(F.lit("q 1 0 0 1 "), number_text(at(F.col("d"), 0)), F.lit(" "), number_text(at(F.col("d"), 1)), F.lit(" cm "))
    own = F.substring(F.col("stream"), F.col("start") + 1, F.col("end") - F.col("start"))
    others = moving.where("kind <> 'path'").join(streams, "page").select("page", F.col("start").alias("s"), F.col("end").alias("e"), F.concat(step, own, F.lit(" Q")).alias("text"), F.lit(False).alias("inserts"))
    return paths.unionByName(others)


def drops(items: DataFrame, operations: DataFrame) -> DataFrame:
    """SPANs that make items paint nothing: a painted path keeps its points, and its clip, and isn't painted; all else but texts goes."""
    last = operations.select("page", F.col("i").alias("i1"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    paths = items.where("kind = 'path' and painted").join(last, ["page", "i1"]).select("page", F.col("_s").alias("s"), F.col("_e").alias("e"), F.lit("n").alias("text"), F.lit(False).alias("inserts"))
    others = items.where("kind not in ('path', 'text')").select("page", F.col("start").alias("s"), F.col("end").alias("e"), F.lit("").alias("text"), F.lit(False).alias("inserts"))
    return paths.unionByName(others)


def number_said(v: float) -> str:
    """number_text of one number."""
    up = v * 10_000 + 0.5
    r = 0 if math.isnan(up) else int(max(-MOST, min(MOST, up if math.isinf(up) else math.floor(up))))
    part = abs(r) % 10_000
    return ("-" if r < 0 else "") + str(math.floor(float(abs(r)) / 10_000)) + (f".{part:04d}".rstrip("0") if part else "")


def moved_text(op: str, v: Sequence[float], dx: float, dy: float) -> str | None:
    """moved_operator of one operator."""
    if op == "re":
        said = [v[0] + dx, v[1] + dy, v[2], v[3]]
    elif op in POINTS:
        said = [x + (dy if i % 2 else dx) for i, x in enumerate(v[: 2 * POINTS[op]])]
    else:
        return None
    return " ".join([*map(number_said, said), op])


def step_in(m: Sequence[float], dy: float) -> tuple[float, float] | None:
    """user_delta of one matrix and a step up."""
    a, b, c, d = m[:4]
    det = a * d - b * c
    return (d / det * 0.0 + -c / det * dy, -b / det * 0.0 + a / det * dy) if det != 0 else None


def edited_stream(stream: str | None, objects: str | None, dys: Sequence[float], gones: Sequence[bool]) -> tuple[str | None, int, int]:
    """A stream whose items, in order, are moved up by dy or dropped, and how many of its spans are kept and dropped."""
    if stream is None or not (any(gones) or any(dys)):
        return stream, 0, 0
    ops, spans = operations(stream), []
    for (i0, i1, kind, start, end, _, ctm, _, _, shown, _), dy, gone in zip(followed(ops, objects), dys, gones, strict=True):
        path = kind == "path"
        if kind == "text":
            continue
        if gone:
            if not path or shown:
                s, e = ops[i1][2:] if path else (start, end)
                spans.append({"s": s, "e": e, "text": "n" if path else ""})
        elif dy and kind != "shading" and (by := step_in(ctm, dy)):
            if path:
                moved = [(s, e, moved_text(op, operands(args), *by)) for op, args, s, e in ops[i0:i1]]
                spans += [{"s": s, "e": e, "text": t} for s, e, t in moved if t is not None]
            else:
                spans.append({"s": start, "e": end, "text": f"q 1 0 0 1 {number_said(by[0])} {number_said(by[1])} cm {stream[start:end]} Q"})
    # no two spans begin at one place: each operator has its own
    text, kept = spliced(stream, sorted(spans, key=lambda r: -r["s"]))
    return text, kept, len(spans) - kept


def edited(streams: DataFrame, dy: Callable[[Column], Column], gone: Callable[[Column], Column]) -> DataFrame:
    """(page, stream, n_kept, n_dropped) of content streams (page, stream, objects: as stream_items takes them) after edits of their items: dy and gone tell of an item, a struct as page_items names its columns, how far it goes up the page and whether it is dropped; null is neither.

    A path's points are written anew, operator by operator; images and forms, inline or not, are wrapped in a moved space.
    Shadings and texts aren't moved, nor what stands in a space that can't be undone. A path that is dropped keeps its
    points, and its clip, and isn't painted; all else but texts goes. Of spans that meet, those further right are kept.

    A page's stream, items and edits are one row throughout: nothing is joined, sorted or sent to the driver. A stream
    that comes again with the same objects and edits is rewritten once; what is kept of them is bounded by KEPT.
    """
    kind = dict(streams.dtypes)["page"]
    steps = F.transform("items", lambda t: F.coalesce(dy(t).cast("double"), F.lit(0.0)))
    goes = F.transform("items", lambda t: F.coalesce(gone(t), F.lit(False)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = {}, 0
        for batch in batches:
            out, at = [], 0
            dys, gones = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            for stream, objects, n in zip(listed(batch.column(1)), listed(batch.column(2)), batch.column(3).value_lengths().to_pylist(), strict=True):
                d, g = dys[at : at + n], gones[at : at + n]
                at += n
                key = (stream, objects, d.tobytes(), g.tobytes())
                new = known.get(key)
                if new is None:
                    new = edited_stream(stream, objects, d.tolist(), g.tolist())
                    if len(stream or "") + len(objects or "") <= SHORT:
                        known[key] = new
                        size += 200 + 9 * n + sum(len(t or "") for t in (stream, objects, new[0]))
                        if size > KEPT:
                            known, size = {}, 0
                out.append(new)
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["page", "stream", "n_kept", "n_dropped"])

    return listed_items(streams).select("page", "stream", "_json", steps.alias("dy"), goes.alias("gone")).mapInArrow(told, f"page {kind}, stream string, n_kept int, n_dropped int")
