"""A host with two templates: the winning path must not take a page's article away."""

import time

import pytest
from pyspark.sql import functions as F

from tracegraph.llm.html import attributes, container_scores, extract, main_text, path_key, read

STORY = " ".join(f"word{k}" for k in range(80))
NEWS = f"<html><body><article class=news><p>{STORY} news</p></article></body></html>"
WIN = ">html>body>article.news"


def test_teaser_or_nothing_at_the_winning_path():
    assert max(container_scores(NEWS), key=container_scores(NEWS).get) == WIN and extract(NEWS, WIN) == (f"{STORY} news", WIN)
    for teaser in ("", "<p>Read this too</p>"):
        page = f"<html><body><article class=news>{teaser}</article><main class=blog><p>{STORY} blog</p></main></body></html>"
        assert extract(page, WIN) == (f"{STORY} blog", ">html>body>main.blog")


def test_the_vote_still_narrows():
    page = f"<html><body><article class=news><p>{STORY} news</p></article><div class=x><p>{STORY}</p></div></body></html>"
    assert extract(page, WIN) == (f"{STORY} news", WIN)


def test_text_outside_containers():
    assert extract(f"<p>{STORY}</p><article class=news></article>", ">article.news")[0] == STORY


def test_attributes():
    got = attributes(""" style='overflow:hidden' aria-hidden=false DATA-id="nav 7" title='a "hidden" gem' hidden class=x class=y""")
    assert got == {"style": "overflow:hidden", "aria-hidden": "false", "data-id": "nav 7", "title": 'a "hidden" gem', "hidden": "", "class": "x"}


@pytest.mark.parametrize(
    "page",
    [
        "<div style='overflow:hidden'><p>{}</p></div>", "<article aria-hidden='false'><p>{}</p></article>", "<article><p title='a hidden gem'>{}</p></article>",
        "<article><p data-id='nav'>{}</p></article>", "<div class='content has-sidebar'><p>{}</p></div>", "<div class='sidebar-layout'><div class='x'><p>{}</p></div></div>",
        "<div class='overlay'><div class='post'><p>{}</p></div><div class='comments'><p>first!</p></div></div>", "<form action='/'><div><p>{}</p></div><input name=q></form>",
        "<body class='modal-open nav'><div><p>{}</p></div>", "<div><p onclick='if (a > b) go()'>{}</p></div>", "<div><p title=\"it's\">{}</p></div>", "<div hidden=false><p>{}</p></div>",
    ],
)
def test_text_stays(page):
    assert extract(page.format(STORY), None)[0] == STORY


@pytest.mark.parametrize(
    "junk",
    [
        "<div hidden>{}</div>", "<p style='color:red; display : none'>{}</p>", "<div role='navigation'>{}</div>", "<div class='site-nav'>{}</div>", "<div id=cookie-consent>{}</div>",
        "<ul class='comments list'><li>{}</li></ul>", "<section class=related-posts>{}</section>", "<div aria-hidden='true'>{}</div>", "<form><p>{}</p></form>", "<div class='ad-slot-3'>{}</div>",
    ],
)
def test_junk_goes(junk):
    page = f"<div class=page><p>{STORY}</p>{junk.format('some other text that is shorter')}<p>{STORY} two</p></div>"
    assert extract(page, None)[0] == f"{STORY}\n{STORY} two"


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + f"<p>{STORY}</p>" + "</div>" * 50_000
    page = read(deep)
    assert len(page.box_up) == 50_000 and extract(deep, None)[0] == STORY
    wide = "<body>" + "<div class=a><p>one two three four five six seven eight nine</p></div>" * 30_000 + "</b>" * 30_000
    assert extract(wide, None)[0].count("\n") == 29_999


def host_page(k, kind):
    more = f"<div class='teaser'><a href='/x'>Read {k}</a> <a href='/y'>more of it</a></div>"
    story = f"<p>{STORY} number {k}</p><p>{STORY} end</p>"
    if kind == "old":
        return f"<html><body><div class=top>Site</div><div class='wrap-{k}'><div class='post-{k}'>{story}</div>{more}</div></body></html>"
    return f"<html><body><div class=shell><main class=text>{story}</main>{more}</div></body></html>"


def test_hosts_with_div_articles_and_two_templates(spark):
    want = lambda k: f"{STORY} number {k}\n{STORY} end"
    rows = [(k, f"https://{'www.' * (k % 2)}one.example/{k}", host_page(k, "old")) for k in range(12)]
    rows += [(k, f"http://two.example:80/{k}", host_page(k, "old" if k % 3 else "new")) for k in range(12, 30)]
    rows += [(40, None, host_page(40, "new")), (41, "not a url", host_page(41, "old")), (42, "https://one.example/z", None), (43, None, ""), (43, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "text", "score", "n_chars", "s", "m")})
    got = main_text(df).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r["text"] == (want(r["page_id"]) if r["page_id"] < 42 else "") and r["n_chars"] == len(r["text"])
    paths = {r["page_id"]: r["path"] for r in got}
    assert {paths[k] for k in range(12)} == {">html>body>div.wrap-#>div.post-#"} and paths[12] == ">html>body>div.shell>main.text"


def test_the_host_decides_where_a_page_alone_would_not(spark):
    """One page's teaser is longer than its article: the path that its host's other pages agree on is read."""
    page = lambda story, teaser: f"<html><body><div class=story><p>{story}</p></div><div class=box><p>{teaser}</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page(f"{STORY} {STORY} {k}", "short")) for k in range(9)] + [(9, "http://h.example/9", page(STORY, f"{STORY} {STORY[:300]}"))]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == f"{STORY} {STORY} 3" and got[9] == STORY
    assert extract(rows[9][2], None)[0] != STORY and extract(rows[9][2], path_key(">html>body>div.story"))[0] == STORY


LONG_TEXT = "Words of an article that goes on and on for quite a while. " * 3


@pytest.mark.parametrize(
    "html",
    [
        "<p>First {t}</p><svg class=i /><p>Last {t}</p>",
        "<p>First {t}</p><iframe src=x /><p>Last {t}</p>",
        "<p>First {t}</p><math><p>Last {t}</p>",
        "<p>First {t}</p><script>var x = 1;\n<p>Last {t}</p>",
        "<div class='ad-free-content'><p>First {t}</p><p>Last {t}</p></div>",
        "<div class='subscribe-content'><p>First {t}</p><p>Last {t}</p></div>",
        "<article><h2 id='related-work'>First</h2><p>{t}</p><p class='side-effects'>Last {t}</p></article>",
    ],
)
def test_text_behind_odd_markup_stays(html):
    text, _ = extract(html.format(t=LONG_TEXT), None)
    assert "First" in text and "Last" in text and "var x" not in text


def test_certain_marks_go_where_the_text_is_elsewhere():
    html = f"<article><p>{LONG_TEXT}</p></article><div class='comments-list'><p>I say {LONG_TEXT}</p></div><p class='ad'>Buy this</p><p class='ad-banner'>Buy that</p>"
    text, _ = extract(html, None)
    assert "Words" in text and "I say" not in text and "Buy" not in text


def test_a_vote_takes_no_path_with_a_third_of_a_page():
    """The host's path holds a third of this page's text: the page's own best container is taken."""
    html = f"<div class='outer'><p>{LONG_TEXT * 2}</p><div class='story'><p>Inner {LONG_TEXT}</p></div></div>"
    assert "Inner" in extract(html, ">div.outer>div.story")[0] and len(extract(html, ">div.outer>div.story")[0]) > 2 * len(LONG_TEXT)


@pytest.mark.parametrize("piece", ["<a ", '<a title="', "<!--", "<svg>", "<", "<a '>\"", "<script>", "<a<", "<div class='a", "</", "&", "<p><b>"])
def test_a_megabyte_of_hostile_markup_takes_seconds(piece):
    began = time.time()
    extract(piece * (1_000_000 // len(piece)), None)
    extract(f"<p>{LONG_TEXT}</p>" + piece * (1_000_000 // len(piece)) + '">', None)
    assert time.time() - began < 40
