"""Main text of web pages by minimum-cut labelling of their blocks (operator 5)."""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav noscript ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Blocks that stand for their text; the element around them is the parent.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary address".split())
NEVER = frozenset("head title noscript template textarea select option svg iframe button object canvas audio video math".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "button", "td", "th", "tr", "caption", "option", "select", "iframe", "svg", "textarea", "noscript", "template", "head", "title", "body", "html"}
#: What an element tells against (positive) or for its blocks being content, by its name.
TAG_COST = {"nav": 3.5, "footer": 3.5, "aside": 3.5, "form": 2.5, "menu": 3.5, "dialog": 3.5, "header": 2.0}
#: The same by words in class, role and (half) id. A word among others in a hyphenated name counts its share of it.
NAME_COST = {
    **dict.fromkeys("ad ads adv advert adverts advertisement adsense cookie cookies consent gdpr notice alert comment comments commentlist disqus replies respond discussion responses related recommended recommendations".split(), 3.5),
    **dict.fromkeys(
        "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget sponsor sponsored promo promotion popup modal overlay newsletter subscribe signup login "
        "toolbar pagination pager share sharing social copyright disclaimer search complementary contentinfo".split(),
        2.5,
    ),
    **dict.fromkeys("header banner masthead".split(), 2.0),
    **dict.fromkeys("articlebody article main".split(), -1.8),
}
#: Words that say the same as a whole id, where others half of it: no chapter is called so.
SURE = frozenset("ad ads adv advert adverts advertisement adsense cookie cookies consent gdpr comments commentlist disqus replies respond nav navbar breadcrumb breadcrumbs sidebar newsletter popup modal footer share sharing toolbar pagination".split())
#: Words that only say what shape an element has: beside them in a hyphenated name the telling word counts in full.
SHAPES = frozenset(
    "slot box buttons button bar block banner container wrapper wrap list item items unit area panel section widget links link icons icon form top bottom left right inner outer row col column strip rail overlay "
    "holder frame zone group menu thread body header footer title heading wrapping list".split()
)
#: What is kept of an element's cost from one block element to the next within, and how much there is at most.
HANDED_DOWN, MOST = 0.95, 4.0
#: Nearness in the tree to an article or main, as an edge to it; such an element is content itself.
IN_CONTENT, ROOT = 1.6, 1e6
TOKEN = re.compile(
    r"(?P<raw><(script|style|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\2\s*>|\Z))"
    r"|(?P<comment><!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z))"
    r"|(?P<tag><(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)"
    r"|(?P<broken></?[a-zA-Z][^>]*+(?:>|\Z))"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.IGNORECASE)
LONG_NUMBER = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{7,});?")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
#: Smoothness: what it costs to part two blocks that follow each other, by how near they are in the tree; and a block from the last one of the same parent.
SAME_PARENT, NEAR_PARENT, ADJACENT = 1.5, 0.35, 0.15


def decoded(text: str) -> str:
    return html.unescape(LONG_NUMBER.sub("�", text)) if "&" in text else text


def names_cost(classes: str, ids: str) -> float:
    """The cost that an element's names tell, its most telling word's.

    A name of words for shapes beside the telling one, such as ad-slot, counts in full; with a word of another matter, such
    as alert-systems, the telling word counts its share of all words and one more. An id counts half, if its word isn't
    SURE: ids also name chapters.
    """
    best = 0.0
    for value, weight in ((classes, 1.0), (ids, 0.5)):
        for name in value.split():
            words = [w.lower() for w in CAMEL.split(name) if w]
            for word in words:
                cost = NAME_COST.get(word, 0.0)
                others = [w for w in words if w != word and w not in SHAPES and w not in NAME_COST]
                found = cost * (1.0 if word in SURE and not others else weight) / (len(words) + 1 if others else 1)
                if abs(found) > abs(best):
                    best = found
    return best


class Frame(NamedTuple):
    """A block element that is open: its number, tag and class, the cost that it and those around it tell, and the number of the article or main it is in, or 0."""

    number: int
    tag: str
    names: str
    cost: float
    content: int


def blocks_of(page: str) -> list[dict]:
    """The blocks of text of a page in order: text, cost of its surroundings, the number of the article or main around it, share of it in links, class of its own element, and the numbers of its parent and grandparent."""
    root = Frame(0, "", "", 0.0, 0)
    stack: list[tuple[str, bool]] = []  # tag, hidden
    frames: list[Frame] = [root, root, root]  # block elements alone, so that a block needn't look for them
    out, parts, linked, size, links, number, skipped = [], [], 0, 0, 0, 0, 0
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked, size
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                own = frames[-1]
                at = -2 if own.tag in LEAF else -1
                out.append({"text": text, "cost": own.cost, "content": own.content, "links": linked / max(size, 1), "names": own.names if at == -2 else "", "parent": frames[at].number, "grand": frames[at - 1].number})
        parts, linked, size = [], 0, 0

    def pop() -> None:
        nonlocal links, skipped
        tag, hidden = stack.pop()
        opened[tag] -= 1
        links -= tag == "a"
        skipped -= tag in NEVER or hidden
        if tag in BLOCK:
            frames.pop()

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if not skipped:
                text = decoded(m[0])
                parts.append(text)
                size += len(text)
                linked += len(text) * (links > 0)
            continue
        if kind != "tag":
            continue
        tag = m[6].lower()
        if tag in BLOCK:
            flush()
        if m[5]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m[7].endswith("/") and tag in NEVER:
            continue
        if tag in CLOSES_P and opened.get("p"):
            while stack[-1][0] != "p":
                pop()
            pop()
        shut = CLOSED_BY.get(tag)
        if shut:
            while stack and stack[-1][0] in shut:
                pop()
        classes, ids, hidden = "", "", False
        if m[7]:
            for n in ATTRIBUTE.finditer(m[7]):
                name, value = n[1].lower(), n[2] or n[3] or n[4] or ""
                if name in ("class", "role"):
                    classes += " " + value
                elif name == "id":
                    ids += " " + value
                hidden |= name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value) is not None
            hidden &= tag not in ("html", "body")
        if tag in BLOCK:
            number += 1
            around = frames[-1]
            told = names_cost(classes, ids) if (classes or ids) and tag not in ("html", "body") else 0.0
            if tag == "main" or tag == "article" and told <= 0:
                frame = Frame(number, tag, classes, 0.0, number)  # what is around an article says nothing about it
            else:
                cost = min(MOST, max(-MOST, around.cost * HANDED_DOWN + told + TAG_COST.get(tag, 0.0) * (not around.content or tag != "header")))
                frame = Frame(number, tag, classes, cost, around.content or (number if tag == "article" else 0))
            frames.append(frame)
        stack.append((tag, hidden))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        skipped += tag in NEVER or hidden
    flush()
    return out


def gain(block: dict) -> float:
    """How much better "content" fits the block than "boilerplate": by the names around it, its length, how it ends and its links. For most blocks it is less than their edges, so that the cut decides."""
    text = block["text"]
    said = 0.5 * (min(len(text) / 40, 4.0) - 1.2 + (1.0 if text[-1] in ".!?…:\"”" else -0.5)) - 2.0 * block["links"]
    return min(1.0, max(-1.0, said)) - block["cost"]


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that loses least: a node with a positive gain loses it if it isn't content, one with a negative gain if it is; an edge costs its weight if its ends differ.

    A node whose gain is no less than all its edges keeps its sign, whatever the others do: so it is left out, and its
    edges become gains of the others. A maximum flow (shortest augmenting paths by levels) from source to sink
    separates the rest; of equally good labellings it is the one with the least content.
    """
    n = len(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [g > 0 if abs(g) >= sum(x.values()) else None for g, x in zip(gains, near, strict=True)]
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    g = [v + sum(w if label[j] else -w for j, w in x.items() if label[j] is not None) for v, x in zip(gains, near, strict=True)]
    source, sink = n, n + 1
    flow: dict[int, dict[int, float]] = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in left}
    flow[source], flow[sink] = {}, {}
    for i in left:
        a, b = (source, i) if g[i] > 0 else (i, sink)
        flow[a][b], flow[b][a] = abs(g[i]), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in flow[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [bool(label[i]) if label[i] is not None else i in level for i in range(n)]
        ways = {u: iter(list(flow[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    flow[a][b] -= least
                    flow[b][a] = flow[b].get(a, 0.0) + least
                path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if flow[a][b] <= 1e-12) + 1]
                continue
            for v in ways[u]:
                if flow[u].get(v, 0.0) > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = minimum_cut(*network(blocks))
    return "\n".join(b["text"] for b, keep in zip(blocks, kept, strict=False) if keep)


def network(blocks: list[dict]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Gains and edges of the blocks and, after them, of each article and main that holds any.

    Edges: each block and the next, by their distance in the tree; each and the last one before of the same parent and
    class; each and the article or main around it.
    """
    edges, last = [], {}
    for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False)):
        same = a["parent"] == b["parent"]
        kin = same or a["grand"] == b["grand"] or a["grand"] == b["parent"] or a["parent"] == b["grand"]
        edges.append((i, i + 1, SAME_PARENT if same and a["names"] == b["names"] else NEAR_PARENT if kin else ADJACENT))
    for i, b in enumerate(blocks):
        if (j := last.get((b["parent"], b["names"]), i - 1)) < i - 1:
            edges.append((j, i, SAME_PARENT))
        last[b["parent"], b["names"]] = i
    roots: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b["content"]:
            edges.append((i, roots.setdefault(b["content"], len(blocks) + len(roots)), IN_CONTENT))
    return [gain(b) for b in blocks] + [ROOT] * len(roots), edges


def main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p if isinstance(p, str) else "") for p in pages], dtype=object)


def extract_text(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of the html. Whole pages are parsed where they are; a row is a page, so nothing moves.

    Blocks are runs of text between block elements (br, too); hidden ones aren't read. A block's terminal capacity is a
    classifier's cost: what the elements around it tell by tag and name, less the farther they are and nothing from
    around an article or main; its length, its end and its share of links. Edges to the next block, to the last one of the
    same parent and to the article or main around it pull near blocks to one label, and for most blocks weigh more than
    their cost. A maximum flow finds the cut.
    Null and empty pages and pages without content have the text ''. Rows and other columns stay, the target is replaced.
    """
    return pages.withColumn(to, F.pandas_udf(main_texts, "string")(F.coalesce(column, F.lit(""))))


def op5_html(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text").select("*", F.length("text").cast("long").alias("n_chars"))
