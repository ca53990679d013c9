"""Main text of pages whose article is known."""

import html
import re
import time

import pytest

from helpers import documents
from quadrille.llm import html as H

P1, P2 = "First paragraph, with commas, and enough text to matter here.", "Second one is shorter, but still long enough to count."
PAGES = {
    "plain article": (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>x</footer></body>",
                      ["Title", P1, P2]),
    "divisions only": (f"<div id=menu><a href=a>One</a> <a href=b>Two</a></div><div class='col'><div class=post-content><p>{P1}</p><div>{P2}</div>"
                       f"<ul><li>Item</li><li><a href=x>link</a></li></ul></div></div><div class='sidebar'><p>Side, bar, text, with, commas.</p></div>",
                       [P1, P2, "Item"]),
    "comments": (f"<article><p>{P1}</p></article><section id=comments><article class=comment><p>A reader, who writes, very, very much, says this "
                 "at length, and then, again, more of it, for long, so that, it scores.</p></article></section>", [P1]),
    "notices and forms": (f"<div class='cookie-notice'><p>{P2}</p></div><main><form><p>{P2}</p></form><p>{P1}</p><aside><p>{P2}</p></aside>"
                          f"<div class=advert>{P2}</div><p hidden>{P2}</p><div style='display: none'>{P2}</div></main>", [P1]),
    "references and space": ("<article><p>Fish &amp; chips&#33;\n\n  caf&eacute; &copy 2 &lt;b&gt;<br>next</p></article>", ["Fish & chips! café © 2 <b> next"]),
    "scripts": (f"<article><script>var t=\"</p><p>no\";</script><style>p{{}}</style><p>{P1}<!-- <p>no</p> --></p></article>", [P1]),
    "unclosed": (f"<article><p><b>{P1}<br><p>{P2}<p", [P1, P2]),
    "nothing": ("<nav><a href=a>One</a></nav><footer>foot</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    assert H.main_text(source).split("\n") == (want or [""])


def test_hostile_pages_end():
    assert H.main_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert H.main_text("<p>a, b" * 20_000).count("\n") == 19_999
    for source in ("<a href='" * 5000, "<", "<!--", "<script>", "</", "a < b", "<p>&#xFFFFFFF; &bogus;", "<b></i></b></p>"):
        H.main_text(source)


def test_operator(spark):
    rows = [(1, PAGES["plain article"][0]), (2, None), (3, ""), (1, PAGES["plain article"][0])]
    got = H.extract(documents(spark, rows, n_chars="clash").withColumnRenamed("text", "html")).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == [(1, len("\n".join(["Title", P1, P2])))] * 2 + [(2, 0), (3, 0)]


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op2_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


PARAGRAPH = "<p>" + "This is a long paragraph, with commas, and many words in it, which make it part of an article. " * 3 + "</p>"


def test_article_in_a_container_named_otherwise_is_kept():
    menu = "<nav><a href=x>Home</a> <a href=y>More</a></nav>"
    for name in ("social-history", "register-guide", "promotion", "share-economy", "notice-board", "related-work"):
        text = H.main_text(f"<html><body>{menu}<div class='{name}'>{PARAGRAPH * 3}</div></body></html>")
        assert text.count("\n") == 2 and "Home" not in text, name
    both = H.main_text(f"<body>{menu}<div>{PARAGRAPH * 3}</div><div class='related'>{PARAGRAPH.replace('long', 'other')}</div></body>")
    assert "other" not in both and both.count("\n") == 2
    assert H.main_text(f"<body><p>Short.</p><div class='comments'>{PARAGRAPH * 3}</div></body>").count("paragraph") == 0


def test_letters_whose_lower_case_is_longer_before_a_script():
    text = H.main_text("<body><div>" + PARAGRAPH + "<p>" + "İ" * 40 + "</p><SCRIPT>var x;</Script>" + PARAGRAPH + PARAGRAPH + "</div></body>")
    assert text.count("paragraph") == 9 and "var" not in text


def test_links_in_tables_and_lists_of_an_article_are_kept_and_menus_are_not():
    rows = "<table><tr><td><a href=x>Ada Lovelace</a></td><td>wrote the first program in 1843</td></tr></table>"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a></li>" for k in range(8)) + "</ul>"
    text = H.main_text(f"<body><article>{PARAGRAPH}{rows}{menu}{PARAGRAPH}</article></body>")
    assert "Ada Lovelace" in text and "1843" in text and "Menu entry" not in text


def test_unbalanced_and_deep_markup_takes_linear_time():
    start = time.process_time()
    for source in ("<div>" * 50_000 + "</section>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<p>x" * 50_000,
                   "<div>" * 50_000 + "text" + "</div>" * 50_000, "</p></div></a>" * 50_000):
        H.main_text(source)
    assert time.process_time() - start < 30
