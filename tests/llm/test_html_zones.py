"""Words that name boilerplate, where they name chapters of an article or stand in other attributes."""

import pytest

from pagewright.llm.html_extract import main_text

SAID = "One sentence of the article, long enough to read without a doubt."


@pytest.mark.parametrize(
    "page",
    [
        f"<main class=page-with-comments><p>{SAID}</p></main>",
        f"<article title='The hidden cost of x'><p>{SAID}</p></article>",
        f"<article><section id=related-work><p>{SAID}</p></section></article>",
        f"<main><section id=recommendations><p>{SAID}</p></section></main>",
        f"<main><div id=discussion><p>{SAID}</p></div></main>",
        f"<div class='layout has-comments'><article><p>{SAID}</p></article></div>",
        f"<form><main><p>{SAID}</p></main></form>",
        f"<article data-role=comment data-x='a hidden b'><p>{SAID}</p></article>",
    ],
)
def test_article_text_stays(page):
    assert main_text(f"<body>{page}</body>") == SAID


def test_heading_with_a_generated_id_stays():
    assert main_text(f"<article><h2 id=discussion>Discussion</h2><p>{SAID}</p></article>") == f"Discussion\n{SAID}"


@pytest.mark.parametrize("attributes", ["hidden", "hidden=''", "aria-hidden=true", "style='color: red; display: none'", "class=comments", "role=alert", "class='ad'"])
def test_boilerplate_goes(attributes):
    assert main_text(f"<main><p>{SAID}</p><div {attributes}><p>Reader: nice article, thank you very much indeed.</p></div></main>") == SAID


def test_comments_that_are_articles_go():
    assert main_text(f"<main><p>{SAID}</p></main><div id=comments><article class=comment-body><p>Reader: nice article, thank you very much.</p></article></div>") == SAID
