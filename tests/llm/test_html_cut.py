"""The minimum cut at work: pages whose blocks it labels against an independent flow, a plain parse, and pages that lose their article tag."""

import re
from collections import defaultdict, deque
from html.parser import HTMLParser

import pytest
from conftest import SF

from pagewright.llm import html_extract
from pagewright.llm.html_extract import main_text

PAGES = SF.replace("0.001", "0.01")
SAID = "One sentence of the article, long enough to read without a doubt."


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{PAGES}/pages.parquet").select("page_id", "html").collect()}


class Article(HTMLParser):
    """The blocks of text in article, without forms and comments."""

    def __init__(self, page):
        super().__init__()
        self.out, self.parts, self.inside = [], [], 0
        self.feed(page)
        self.close()

    def flush(self):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(self.parts)).strip(" ")
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK and self.inside:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK and self.inside:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_query_matches_a_plain_parse(spark, pages):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op5_html(spark, PAGES).collect()}
    want = {i: "\n".join(Article(p).out) for i, p in pages.items()}
    right = sum(got[i] == (want[i], len(want[i])) for i in want)
    assert set(got) == set(want) and right >= 0.95 * len(want)


def least_loss(gains, edges):
    """The value of a minimum cut by augmenting one path at a time, with capacities in whole millionths."""
    n, cap = len(gains), defaultdict(lambda: defaultdict(int))
    for i, g in enumerate(gains):
        a, b = ("s", i) if g > 0 else (i, "t")
        cap[a][b] += round(abs(g) * 1e6)
        cap[b][a] += 0
    for a, b, w in edges:
        cap[a][b] += round(w * 1e6)
        cap[b][a] += round(w * 1e6)
    total = 0
    while True:
        came, queue = {"s": None}, deque(["s"])
        while queue and "t" not in came:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in came:
                    came[v] = u
                    queue.append(v)
        if "t" not in came:
            return total / 1e6
        path, v = [], "t"
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        least = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= least
            cap[b][a] += least
        total += least
    return n


def bare(page):
    """The page with its article as a plain div."""
    return page.replace("<article", "<div").replace("</article", "</div")


@pytest.mark.parametrize("change", [str, bare])
def test_labels_lose_no_more_than_an_independent_flow(pages, change):
    for page in list(pages.values())[:60]:
        blocks = html_extract.blocks_of(change(page))
        gains, edges = html_extract.network(blocks)
        labels = html_extract.minimum_cut(gains, edges)
        loss = sum(max(g, 0) * (not y) + max(-g, 0) * y for g, y in zip(gains, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        assert abs(loss - least_loss(gains, edges)) < 1e-3


@pytest.mark.parametrize("change", [str, bare])
def test_the_cut_decides_what_is_kept(pages, change):
    relabelled = blocks_in_all = found = wanted = kept = clean = 0
    for page in pages.values():
        want = set(Article(page).out)
        blocks = html_extract.blocks_of(change(page))
        gains, edges = html_extract.network(blocks)
        labels = html_extract.minimum_cut(gains, edges)[: len(blocks)]
        relabelled += sum(label != (g > 0) for g, label in zip(gains, labels, strict=False))
        blocks_in_all += len(blocks)
        for block, label in zip(blocks, labels, strict=True):
            wanted += block["text"] in want
            kept += label
            found += label and block["text"] in want
            clean += label and block["text"] in want
    assert relabelled > 0.02 * blocks_in_all
    assert found >= 0.95 * wanted and clean >= 0.95 * kept


HARD = [
    ('<main><section class="alert-systems"><p>{s}</p></section></main>', True),
    ("<main><p>{s}</p><section id=comments><h2>Comments</h2><p>Reader: nice article, thank you very much indeed.</p></section></main>", True),
    ('<article><p>{s}</p><div class="ad-slot"><p>Buy our fine shoes today, they are half the price.</p></div></article>', True),
    ('<article><p>{s}</p><div class="share-buttons"><a href=x>Tweet</a><a href=y>Share</a></div></article>', True),
    ('<article><p>{s}</p><div class="cookie-banner"><p>We use cookies to make this site work well.</p></div></article>', True),
    ("<main><p>{s}</p><div class=newsletter-form><p>Get our letter every week, for free.</p></div></main>", True),
    ("<main><section class=notice-periods><h2>Periods</h2><p>{s}</p></section></main>", None),
]


@pytest.mark.parametrize(("page", "alone"), HARD)
def test_hard_names(page, alone):
    for said in (SAID, "A short sentence here."):
        want = said if alone else f"Periods\n{said}"
        assert main_text(f"<body>{page.format(s=said)}</body>") == want


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post ad-free"><p>{SAID}</p></article>',
        f'<main class="has-cookie-bar"><p>{SAID}</p></main>',
        f'<div class="single comments-open"><article><p>{SAID}</p></article></div>',
        f'<div class="related-posts-off"><main><p>{SAID}</p></main></div>',
        f'<div class="ad"><main><p>{SAID}</p></main></div>',
    ],
)
def test_names_on_wrappers_leave_the_article(page):
    assert main_text(f"<body>{page}</body>") == SAID


def test_long_pages_with_unclosed_elements():
    page = "<b>" * 20_000 + f"<p>{SAID}</p>" * 2_000
    assert main_text(page) == "\n".join([SAID] * 2_000)
