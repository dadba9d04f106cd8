"""Lines of pages whose items lie together and in order: what grouping.engine_lines tells, on columns of whole pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagewright.functions.scripts import INDIC
from pagewright.operators import grouping
from pagewright.operators.grouping import BACK, EVEN, EVEN_PART, LEAST, OFF, ON, SEVERAL, SINGLE, SLANT, WIDE, WORD

#: Items of whole pages that are worked on at a time, at least.
ITEMS = 1 << 16
#: What a regular expression of Java takes for white space, and the line ends before which $ matches too.
BLANKS, ENDS = " \t\n\x0b\x0c\r\u00a0\ufeff", ("\u0085", "\u2028", "\u2029")
PLACES = ("e", "f", "a", "b", "c", "ux", "uy", "size", "width")
MADE = [("line", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "size", "width")], ("fonts", pa.list_(pa.string()))]


def codes(column: pa.Array) -> np.ndarray:
    """A number for each value, -1 for null."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def without_end(text: pa.Array) -> pa.Array:
    """grouping.without_end on Arrow."""
    out = pc.utf8_rtrim(text, characters=BLANKS)
    odd = np.flatnonzero(np.logical_or.reduce([pc.ends_with(text, t).to_numpy(zero_copy_only=False) for t in ENDS]))
    if len(odd):
        out = out.to_pylist()
        for i in odd:
            out[i] = out[i][:-1].rstrip(BLANKS) + out[i][-1]
        out = pa.array(out, pa.string())
    return out


def joined(parts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(parts)), pa.int32()), parts), by)


def by_turns(k: np.ndarray, v: dict[str, np.ndarray], out: dict[str, np.ndarray]) -> None:
    """The runs of a page's items k, one after another, as grouping.run_step tells them: into `out`, for each item its run's first item (-1: none), whether a space is before it, how far the run reaches then, and for the first whether it follows."""
    open_ = wide = reach = None
    reached, font, eols = {}, v["font"], None
    for i in k:
        if eols != v["eols"][i]:
            eols, open_, wide = v["eols"][i], None, None
        out["of"][i] = -1
        e, f, size, width = v["e"][i], v["f"][i], v["size"][i], v["width"][i]

        def told(r: int) -> tuple[float, bool]:
            dx, dy, near = e - v["e"][r], f - v["f"][r], SLANT * size  # noqa: B023
            off = dy * v["ux"][r] - dx * v["uy"][r]
            same = font[i] >= 0 and font[i] == font[r] and all(abs(v[c][i] - v[c][r]) < near for c in ("size", "b", "c")) and abs(off) < OFF * size  # noqa: B023
            return dx * v["ux"][r] + dy * v["uy"][r], same

        if v["blank"][i] and width > WIDE * size:
            open_, wide = None, wide if open_ is None else open_
            continue
        if open_ is not None:
            along, same = told(open_)
            reach = reached[open_]
            if same and along >= reach - BACK * size and along - reach <= ON * size:
                out["of"][i], out["gap"][i] = open_, along - reach > WORD * size
                reached[open_] = out["reach"][i] = max(reach, along + width)
                continue
        if not v["blank"][i]:
            out["follows"][i] = False
            if wide is not None:
                along, same = told(wide)
                out["follows"][i] = same and along > reached[wide]
            out["of"][i], out["gap"][i], open_, wide = i, False, i, None
            reached[i] = out["reach"][i] = width


def runs_of(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What by_turns tells, at once: an item's run is that of the item before if both stand alike. Where that doesn't give what one item after another gives, the page is done by turns."""
    n = len(v["e"])
    k, p = np.arange(n), np.maximum(np.arange(n) - 1, 0)
    size, width, e, f, ux, uy = (v[c] for c in ("size", "width", "e", "f", "ux", "uy"))
    near = SLANT * size
    wide = v["blank"] & (width > WIDE * size)
    held = (k > 0) & (v["page"] == v["page"][p]) & (v["eols"] == v["eols"][p])

    def alike(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = e - e[r], f - f[r]
        same = (v["font"] >= 0) & (v["font"] == v["font"][r]) & (np.abs(dy * ux[r] - dx * uy[r]) < OFF * size)
        for c in ("size", "b", "c"):
            same &= np.abs(v[c] - v[c][r]) < near
        return dx * ux[r] + dy * uy[r], same

    maybe = held & ~wide[p] & ~wide
    same = alike(p)[1] & maybe
    ahead = e * ux - (e * ux + width)[p]
    on = same & (ahead >= -BACK * size) & (ahead <= ON * size)
    of = np.maximum.accumulate(np.where(on, 0, k))
    before = of[p]
    along, dx_ok = alike(before)
    reach = np.where(on, along + width, width)
    exact = same & (along >= reach[p] - BACK * size) & (along - reach[p] <= ON * size)
    equal = np.logical_and.reduce([v[c] == v[c][p] for c in ("size", "b", "c", "ux", "uy", "f")])
    finite = np.logical_and.reduce([np.isfinite(v[c]) for c in PLACES if c != "a"])
    odd = ~finite | (exact != on) | (maybe & (uy[p] != 0)) | (on & ~(equal & dx_ok & (reach >= reach[p]))) | (v["blank"] & ~wide & ~on)
    # a run after a wide gap follows the one before it
    text = np.maximum.accumulate(np.where(wide, -1, k))
    last = np.maximum(text[p], 0)
    r = of[last]
    along_r, same_r = alike(r)
    linked = held & wide[p] & ~wide & (text[p] >= 0) & (v["page"] == v["page"][last]) & (v["eols"] == v["eols"][last])
    out = {"of": np.where(wide, -1, of), "gap": on & (along - reach[p] > WORD * size), "reach": reach, "follows": linked & same_r & (along_r > reach[last])}
    if odd.any():
        pages = np.unique(v["page"][odd])
        turns = np.flatnonzero(np.isin(v["page"], pages))
        for part in np.split(turns, np.flatnonzero(np.diff(v["page"][turns])) + 1):
            by_turns(part, v, out)
    return out


def page_lines(t: pa.RecordBatch, odd_fonts: list[str]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch of whole pages' items."""
    flag = lambda c: t.column(c).to_numpy(zero_copy_only=False)
    column = {c: t.column(c).to_numpy(zero_copy_only=False) for c in PLACES}
    kept = (pc.binary_length(t.column("text")).to_numpy(zero_copy_only=False) > 0) & ~(column["size"] < LEAST)
    # a wide gap ends no line
    eol = (flag("eol") & ~(kept & flag("blank") & (column["width"] > WIDE * column["size"]))).astype(np.int64)
    v = column | {"page": codes(t.column("page")), "font": codes(t.column("font")), "blank": flag("blank"), "ends": flag("ends"), "opens": flag("opens"), "eols": np.cumsum(eol) - eol}
    # a page that comes again later is another one
    v["page"] = np.cumsum(np.append(0, np.diff(v["page"]) != 0))
    row = np.flatnonzero(kept)
    v = {c: x[row] for c, x in v.items()}
    if not len(row):
        return
    with np.errstate(all="ignore"):
        run = runs_of(v)
        m = np.flatnonzero(run["of"] >= 0)
        if not len(m):
            return
        start = run["of"][m] == m
        first, at = np.flatnonzero(start), m[start]
        word = t.column("text").take(pa.array(row[m]))
        space = run["gap"][m] & ~np.append(False, v["ends"][m][:-1]) & ~v["opens"][m]
        if space.any():
            word = pc.if_else(pa.array(space), pc.binary_join_element_wise(" ", word, ""), word)
        text = joined(word, first, "")
        r = {c: v[c][at] for c in ("page", *PLACES)}
        r["width"] = run["reach"][m[np.append(first[1:], len(m)) - 1]]
        follows, p = run["follows"][at], np.maximum(np.arange(len(at)) - 1, 0)
        # chains of runs that follow
        gap = (r["e"] - r["e"][p]) * r["ux"][p] + (r["f"] - r["f"][p]) * r["uy"][p] - r["width"][p]
        head = np.flatnonzero(~follows)
        n = np.diff(np.append(head, len(at))) - 1
        most, least = np.maximum.reduceat(np.where(follows, gap, -np.inf), head), np.minimum.reduceat(np.where(follows, gap, np.inf), head)
        joins = (n > 0) & (most <= np.where(n > 1, SEVERAL, SINGLE) * r["size"][head]) & (most - least <= np.maximum(EVEN, EVEN_PART * most))
        begins = ~follows | ~np.repeat(joins, n + 1)
        lead = np.flatnonzero(begins)
        tail = np.append(lead[1:], len(at)) - 1
        several = tail > lead
        if several.any():
            inner, outer = ~begins, np.append(~begins[1:], False)
            text = pc.if_else(pa.array(outer), without_end(text), text)
            text = pc.if_else(pa.array(inner), pc.utf8_ltrim(text, characters=BLANKS), text)
        text = joined(text, lead, " ")
        far = (r["e"][tail] - r["e"][lead]) * r["ux"][lead] + (r["f"][tail] - r["f"][lead]) * r["uy"][lead] + r["width"][tail]
        width = np.where(several, far, r["width"][lead])
    number = lead - np.maximum.accumulate(np.where(np.append(True, np.diff(r["page"]) != 0), np.arange(len(at)), 0))[lead]
    origin = pa.array(row[at[lead]])
    page, font = t.column("page").take(origin), t.column("font").take(origin)
    numbers = {c: r[c][lead] for c in ("e", "f", "b", "c", "size")} | {"width": width}
    whole = lambda a: pa.array(a, pa.float64(), from_pandas=True)
    indic = pc.match_substring_regex(text, INDIC).to_numpy(zero_copy_only=False)
    own = np.ones(len(lead), bool)
    if indic.any():
        own = ~np.isin(r["page"][lead], np.unique(r["page"][lead][indic]))
        given = np.flatnonzero(~own)
        texts, fonts = text.take(pa.array(given)).to_pylist(), font.take(pa.array(given)).to_pylist()
        ends, opens, odd = [bool(re.search(f"[{BLANKS}][{''.join(ENDS)}]?\\Z", x)) if not x or x[-1] in ENDS else x[-1] in BLANKS for x in texts], [x[:1] in BLANKS and x != "" for x in texts], [x in odd_fonts for x in fonts]
        letters = [bool(re.search("[A-Za-z]", x)) for x in texts]
        lines = [page.take(pa.array(given)), pa.array(number[given], pa.int32()), pa.array(texts, pa.string()), pa.array(fonts, pa.string()), *[whole(numbers[c][given]) for c in (*"efbc", "size", "width")], *[pa.array(x, pa.bool_()) for x in (indic[given].tolist(), letters, ends, opens, odd)]]
        batch = pa.RecordBatch.from_arrays(lines, ["page", "line", "text", "font", *"efbc", "size", "width", "indic", "latin", "ends", "opens", "odd"])
        yield from grouping.join_step(pa.schema(MADE))(iter([batch]))
    keep = np.flatnonzero(own)
    if len(keep):
        fonts = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1), pa.int32()), font.take(pa.array(keep)))
        yield pa.RecordBatch.from_arrays([page.take(pa.array(keep)), pa.array(number[keep], pa.int32()), text.take(pa.array(keep)), *[whole(numbers[c][keep]) for c in ("e", "f", "size", "width")], fonts], ["page", *(c for c, _ in MADE)])


def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (page, text, font, a to f, width, eol) with what runs are told by: size, direction, and where white space is, as SPACE before Java's ^ and $ says."""
    for t in batches:
        whole = {c: pc.cast(t.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in (*"abcdef", "width")}
        by = np.hypot(whole["a"], whole["b"])
        by = np.where(by == 0, 1.0, by)
        text = pc.fill_null(t.column("text"), "")
        n = pc.binary_length(text).to_numpy(zero_copy_only=False)
        length = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False)
        end = without_end(text)
        blank, ends, opens = (length(end) == 0) | pc.is_in(end, pa.array(ENDS)).to_numpy(zero_copy_only=False), length(end) < n, length(pc.utf8_ltrim(text, characters=BLANKS)) < n
        made = {"page": t.column("page"), "text": text, "font": t.column("font")} | whole | {"eol": pc.fill_null(t.column("eol"), False), "size": np.hypot(whole["c"], whole["d"]), "ux": whole["a"] / by, "uy": whole["b"] / by, "blank": blank, "ends": ends, "opens": opens}
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], list(made))


def line_step(odd_fonts: list[str], made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items, which come by page and in order, to lines: whole pages of ITEMS items or more at a time."""

    def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

    def finished(lines: pa.RecordBatch) -> pa.RecordBatch:
        text = without_end(lines.column("text"))
        blank = pc.or_(pc.equal(text, ""), pc.is_in(text, pa.array(ENDS)))
        return lines.set_column(2, "text", text).filter(pc.invert(blank))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, ITEMS
        for batch in made(batches):
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                t = whole(held)
                page = codes(t.column("page"))
                other = np.flatnonzero(page != page[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from map(finished, page_lines(t.slice(0, cut), odd_fonts))
                held, n = [t.slice(cut)], t.num_rows - cut
                enough = max(ITEMS, 2 * n)
        if held:
            yield from map(finished, page_lines(whole(held), odd_fonts))

    return folded


LINES = "line int, text string, x double, y double, size double, width double, fonts array<string>"


def made_lines(rows: DataFrame, kind: str, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], odd_fonts: list[str] | None = None) -> DataFrame:
    """What placed_lines tells of the items that `made` makes of Arrow batches of rows inside a task, pages of this kind of key: items needn't leave it then."""
    return rows.mapInArrow(line_step(odd_fonts or [], lambda batches: flagged(made(batches))), f"page {kind}, {LINES}")


def placed_lines(items: DataFrame, odd_fonts: list[str] | None = None) -> DataFrame:
    """What grouping.engine_lines tells of items (page, seq, text, font, a to f: the matrix, width, eol) that lie by page and in order already, as those made from a page's row do: they are neither dealt nor sorted, and seq is not read.

    A task holds ITEMS items and a page at a time, as columns. Runs, chains and lines are told at once for all items;
    pages where an item's run can't be told from the item before, and lines of pages with Indic text, go one by one.
    """
    return made_lines(items.select("page", "text", "font", *"abcdef", "width", "eol"), dict(items.dtypes)["page"], iter, odd_fonts)
