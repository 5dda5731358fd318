"""Extraction on whole pages: against the text between a page's article tags, without the scan, with names that nobody lists."""

import html
import re

import pytest

from llm import extraction
from tests.oracle import connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages():
    return connection(SF).execute("SELECT page_id, html FROM pages ORDER BY page_id").fetchall()


def plain(page):
    """The test pages' articles hold headings, paragraphs, bold text and line breaks."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    texts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_pages_equal_the_plain_version(spark, pages):
    got = {r["page_id"]: r["text"] for r in extraction.op3_extraction(spark, SF).collect()}
    assert got == {i: plain(h) for i, h in pages}


def test_without_the_scan_pages_are_worse(pages):
    weights = extraction.learn(h for _, h in pages)
    f1 = lambda got, want: 2 * len(set(got.split()) & set(want.split())) / (len(set(got.split())) + len(set(want.split())))
    other, score = 0, 0.0
    for _, h in pages:
        tokens = extraction.tokens(h, weights.odds)
        kept = " ".join(" ".join(html.unescape(t.text) for t in tokens if t.kind == "word" and not t.odds).split())
        other += kept != " ".join(plain(h).split())
        score += f1(kept, plain(h))
    assert other == len(pages) and score / len(pages) < 0.99


@pytest.mark.parametrize("name", ["adbox", "promotion", "kasten", "x1", "content"])
def test_short_strangers_go_whatever_their_names(pages, name):
    weights = extraction.learn(h for _, h in pages)
    text = "This is the body of the article with many words in it. " * 4
    body = f"<p>{text}</p><p>{text}</p>"
    want = f"{text.strip()}\n\n{text.strip()}"
    for page in (f"<div class={name}>Buy now cheap stuff</div><div>{body}</div>", f"<div>{body}</div><div class={name}>Buy now cheap stuff</div>", f"<ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><section id={name}>{body}</section>"):
        assert extraction.main_text(f"<html><body>{page}</body></html>", weights) == want


def test_labels_by_structure():
    page = "<body><p>before</p><article><p>one two three</p></article><p>after</p></body>"
    got = extraction.structured(page)
    assert [(c, what) for c, _, kind, what in got if kind == "word"] == [(False, "before"), (True, "one two three"), (False, "after")]
    assert extraction.structured("<article>a</article><article>b</article>") == [] and extraction.structured("<p>no article</p>") == []
    assert extraction.structured("<p>many more words outside than in it</p><article>one</article>") == []


def test_pages_of_one_structure_count_once(pages):
    some = [h for _, h in pages]
    assert extraction.learn(some).tag == extraction.learn(some[-1:]).tag or abs(extraction.learn(some).tag["div"] - extraction.learn(some[-1:]).tag["div"]) < 0.5
    assert extraction.learn([]).word > 0 and extraction.learn([None or "", "<p>x"]).word > 0
