import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import pytest

from varietas.llm import htmltext
from varietas.llm.htmltext import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site <a href="/">home</a></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice"><p>We use cookies, you know, and we want you to accept all of them.</p></div>
<div class="ad">Buy now, it is cheap. Really.</div>
<main><article><header><h1>The title</h1></header>
<p><b>First paragraph, with &lt;marks&gt; &amp; some &eacute; text. It goes on,
   and on; there is more.<br><p>Second   paragraph, of some length too, so that it is content.</p><p>Short.</p>
<ul><li>item one<li>item two</ul><form><input value="x"><button>Send</button></form>
<aside>Related: much text, with commas, and so on, and on, and on, for a while.</aside></article>
<section id="comments"><p>What a nice article, I liked it, thank you very much.</p></section></main>
<div id="sidebar"><p>Sidebar text, which is long, and has commas, and dots. And more.</p></div>
<footer>&copy; all rights</footer></body></html>"""


def test_the_article_stays_and_nothing_else():
    assert main_text(PAGE).split("\n") == [
        "The title",
        "First paragraph, with <marks> & some é text. It goes on, and on; there is more.",
        "Second paragraph, of some length too, so that it is content.",
        "Short.",
        "item one",
        "item two",
    ]


def test_content_without_semantic_elements():
    page = "<html><body><table><tr><td><a>Home</a></td><td><a>News</a></td></tr></table><div><div><p>" + "</p><p>".join(f"Paragraph {i}, of the story, goes on for a while. It does." for i in range(6)) + "</p><p>End.</p></div></div></body></html>"
    lines = main_text(page).split("\n")
    assert lines == [*(f"Paragraph {i}, of the story, goes on for a while. It does." for i in range(6)), "End."]


STORY = "<p>The story begins here, and it goes on for a while. It does.</p><p>It ends, at last, in this line.</p>"


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='content with-comments'", "div id='page' class='no-banner'", "section class='post share-enabled'", "div class='sidebar-right'", "div id='comments-wrapper'"])
@pytest.mark.parametrize("inner", [f"<article>{STORY}</article>", f"<h1>Title</h1><div>{STORY}</div>"])
def test_marks_on_what_holds_the_article_are_none(wrapper, inner):
    page = f"<html><body><div class='menu'><a>Home</a></div><{wrapper}>{inner}<div class='sidebar'><p>Else, in short.</p></div></{wrapper.split()[0]}></body></html>"
    text = main_text(page)
    assert "begins here" in text and "at last" in text and "Home" not in text and "Else" not in text


def test_no_block_of_text_closes_the_selection():
    long, short = "A long sentence, of the story. " * 29, "A short one, which is the end. " * 3
    lines = [long.strip(), short.strip()]
    assert main_text(f"<div><h1>Title</h1><p>{long}</p><p>{short}</p></div>").split("\n") == ["Title", *lines]
    assert main_text(f"<h1>Title</h1><p>{long}</p><p>{short}</p>").split("\n") == ["Title", *lines]
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li></ul>"
    assert main_text(f"<body>{menu}<div><h1>Title</h1><p>{long}</p></div><div><h2>Part</h2><p>{short}</p></div></body>").split("\n") == ["Title", lines[0], "Part", lines[1]]
    assert main_text(f"<body>{menu}<div><h1>Title</h1><div>{long}</div><div>{short}</div></div></body>").split("\n") == ["Title", *lines]
    assert main_text(f"<body>{menu}<table><tr><td>Links</td><td><h1>Title</h1><p>{long}</p><p>{short}</p></td></tr></table></body>").split("\n") == ["Title", *lines]


@pytest.mark.parametrize("title", ["<div class='post-header'><h1>Title</h1></div>", "<h1 class='entry-header'>Title</h1>"])
def test_titles_stay(title):
    assert main_text(f"<body><div>{title}{STORY}</div><div class='site-header'><h1>Site</h1></div></body>").startswith("Title\nThe story")


def test_long_comments_and_other_articles_stay_out():
    said = "<article class='comment-body'><p>What a nice story, I liked it, thank you very much.</p></article>" * 4
    teasers = "<div class='related'><article><p>Another story, of some length, to read.</p></article></div>"
    text = main_text(f"<body><div><h1>Title</h1><div>{STORY}</div></div><div id='comments'>{said}</div></body>")
    assert "begins here" in text and "nice" not in text
    assert main_text(f"<body><div class='ad'>{STORY}</div><article><h1>Title</h1><p>Short.</p></article></body>") == "Title\nShort."
    text = main_text(f"<body>{teasers}<div class='sidebar-left'><article>{STORY}</article>{teasers}<div id='comments'>{said}</div></div></body>")
    assert "begins here" in text and "nice" not in text and "Another" not in text


@pytest.mark.parametrize(
    "page, want",
    [("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\nb"), ("<article><p>a<script>if(a<b){}</script>b</p><!-- x", "ab"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ("<p>a &lt;b&gt; &#233;&nbsp;c</p>", "a <b> é c"), ("<<<>>>", "<<<>>>"), ("<p></p>", "")],
)
def test_edges(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages():
    assert len(main_text("<article>" + "<p>word word, word.</p>" * 20_000 + "</article>").split("\n")) == 20_000
    assert main_text("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x"), (2, "v", "", "y")]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 4 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Article(HTMLParser):
    """The text of article elements as the driver's pages have them, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in ("article", "p", "h1", "ul", "li", "div"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")
        if tag in ("article", "p", "h1", "ul", "li", "div"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.lines[-1] += data


def by_another_parser(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)


@pytest.fixture(scope="module")
def pages():
    return pd.concat(pd.read_parquet(f"/root/testdata/{sf}/pages.parquet", columns=["html"]) for sf in ("sf0.001", "sf0.01"))["html"].fillna("").tolist()


def test_driver_pages_against_another_parser(pages):
    assert [main_text(p) for p in pages] == [by_another_parser(p) for p in pages]


def test_the_score_decides(pages, monkeypatch):
    """With one score for all paths hardly a page comes out right."""
    monkeypatch.setattr(htmltext, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
    assert sum(main_text(p) == by_another_parser(p) for p in pages) <= 0.05 * len(pages)


def test_neutral_tags_and_no_classes(pages):
    right = told = wanted = 0
    for page in pages:
        plain = re.sub(r"<(/?)(nav|article|footer|header|aside|main|section)\b", r"<\1div", page)
        got, want = (Counter(t.split("\n")) for t in (main_text(re.sub(r"\sclass=(\"[^\"]*\"|'[^']*'|\S+?)(?=[\s>])", "", plain)), by_another_parser(page)))
        right, told, wanted = right + sum((got & want).values()), told + sum(got.values()), wanted + sum(want.values())
    assert right >= 0.96 * told and right >= 0.99 * wanted
