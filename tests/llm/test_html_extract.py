import re
from collections import Counter

from docgrain.llm import html_extract
from docgrain.llm import html_extract as H

from .helpers import TINY, table

LONG = "This is the text of the article and it goes on for a while, so that it is beyond the limit at which a block is seen as running text by the rules of the first pass, which look at the share of the stop words that it has and at its length."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>No</title>{head}</head><body>{body}</body></html>"


def test_article_alone():
    html = page(
        f"""<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home and the rest of it</a></li></ul></nav>
        <div class="cookie-notice"><p>{LONG}</p></div><script>var t = "</p><p>{LONG}</p>";</script><style>p {{}}</style>
        <!-- <p>{LONG}</p> --><article class="post has-sidebar"><h1>Title &amp; more</h1><p>First <b>bold</b>word
        <br> and&nbsp;next.</p><p>{LONG}</p><ul><li>One</li><li>Two<li>Three</ul><aside>Aside {LONG}</aside>
        <form><p>Mail: {LONG}</p><input></form><p>End.<p>Really.</article>
        <section id="comments"><article class="comment"><p>{LONG}</p></article></section>
        <div class="sidebar"><p>{LONG}</p></div><footer>&copy; {LONG}</footer>"""
    )
    assert H.main_text(html).split("\n\n") == ["Title & more", "First boldword and next.", LONG, "One", "Two", "Three", "End.", "Really."]


def test_without_an_article():
    html = page(f"""<div id=top-menu><a href=x>A</a> <a href=y>B</a></div><div class=content><h2>Heading</h2><p>{LONG}</p><p>Short one.</p>
        <p>{LONG}</p></div><p><a href=1>one link</a> <a href=2>and another link</a></p><div class="related-posts"><p>{LONG}</p></div>""")
    assert H.main_text(html).split("\n\n") == ["Heading", LONG, "Short one.", LONG]


def test_passes():
    def block(text, links=0, bad=False, region=1):
        return H.Block(text, links, bad, region)

    assert H.first_pass(block(LONG)) == "good" and H.first_pass(block(LONG, bad=True)) == "bad"
    assert H.first_pass(block(LONG, len(LONG))) == "bad" and H.first_pass(block("short")) == "short"
    assert H.first_pass(block("zq " * 80, region=0)) == "bad" and H.first_pass(block("zq " * 80)) == "short"
    found = [block("x") for _ in range(6)]
    for b, label in zip(found, ("bad", "short", "short", "near", "good", "short")):
        b.label = label
    H.second_pass(found)
    assert [b.label for b in found] == ["bad", "bad", "good", "good", "good", "good"]


def bare(html):
    """The page without articles, navs, classes and ids: what is left are densities, lengths, neighbours and the footer."""
    return re.sub(r"(<[a-z][^>]*?)\s(?:class|id)=(?:\"[^\"]*\"|[^\s>]+)(?=[\s>])", r"\1", re.sub(r"<(/?)(?:article|nav)\b", r"<\1div", html))


def marked(html):
    """What the pages at hand mark as their article, block by block, by a reading of its own."""
    body = html[html.index("<article>") + 9 : html.index("</article>")]
    from html import unescape

    found = (" ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)>", body))
    return [x for x in found if x]


def test_articles_of_the_pages_with_and_without_their_marks():
    pages = [h for h in table(TINY, "pages").html if h]
    right = got = want = 0
    for html in pages:
        asked = marked(html)
        assert H.main_text(html) == "\n\n".join(asked)
        found = H.main_text(bare(html)).split("\n\n")
        assert found != [""] or not asked
        right, got, want = right + sum((Counter(found) & Counter(asked)).values()), got + len(found), want + len(asked)
    assert len(pages) > 20 and right / got >= 0.97 and right / want >= 0.97


def test_each_rule_decides_some_blocks():
    pages = [f(h) for h in table(TINY, "pages").html if h for f in (str, bare)]
    pages += [page(f"<div><p>{LONG}</p><p>short <a href=x>l</a> {'and so on of it all ' * 3}</p><p><a href=x>a</a> bcdefghij</p><p>{'zq ' * 80}</p></div>")]
    pages += [page("<p><a href=/x>link here</a></p><div><p>so be it</p></div><div><p>" + LONG + "</p></div>"), page(f"<aside>{LONG}</aside><p>so be it</p><p>{LONG}</p>"), page(f"<article><p>{LONG}</p></article><p>so be it</p>")]
    pages += [page(f"<p>{'昨天晚上附近所有村庄的居民都聚集在河边' * 15}</p>"), page(f"<p>see <a href=/x>it</a> and more of the rest of it here</p><p>{LONG}</p>")]
    pages += [page(f"<article><p>{'the zq zq zq zq zq ' * 20}</p></article>")]
    rules = Counter((b.rule, b.label) for h in pages for b in H.judged(h))
    for rule in ("place", "link density", "short with a link", "no stop words"):
        assert rules[rule, "bad"] and not rules[rule, "good"], (rule, rules)
    for rule in ("stop words and length", "some stop words, length and article", "length", "likeliest"):
        assert rules[rule, "good"] and not rules[rule, "bad"], (rule, rules)
    for label in ("good", "bad"):
        assert rules["nearest", label], rules
    assert rules["no neighbour", "bad"] and rules["as near", "bad"] and not rules["", "good"] and not rules["", "bad"]


def test_densities_decide_inside_articles():
    links = "<p><a href=/a>Another page of this site</a> | <a href=/b>and one more of them</a></p>"
    assert H.main_text(page(f"<article><p>{LONG}</p>{links}<p>Short.</p><p>{LONG}</p></article>")) == f"{LONG}\n\nShort.\n\n{LONG}"
    assert H.main_text(page(f"<article>{links}<p>Short.</p>{links}<div><p>{LONG}</p></div></article>")) == LONG, "a short block among links"
    far = (LONG + " " + LONG[:200]).strip()
    assert H.main_text(page(f"<article><p>{LONG}</p></article><p>{far}</p><p>Short.</p>")) == f"{LONG}\n\n{far}\n\nShort.", "long text outside stands for itself"


def test_pages_that_used_to_lose_their_text():
    assert H.main_text(f"<html><head><title>t</title><meta charset=utf-8><body><p>{LONG}</p></body></html>") == LONG, "no </head>"
    assert H.main_text(page(f"<article><p><a href=/x>Read</p><p>{LONG}</p><p>{LONG[:90]}</p></article>")) == f"{LONG}\n\n{LONG[:90]}", "<a> never closed"
    assert H.main_text(page(f"<article><a href=/x><p>{LONG}</p><p>{LONG[:90]}</p><a href=/y>Other</a></article>")) == LONG[:90], "it ends with the block it begins in"
    for name in ("page widget-page", "news-related-article-body", "site sidebar-layout"):
        assert H.main_text(page(f'<div class="{name}"><p>{LONG}</p></div>')) == LONG, name
    assert H.main_text(page(f"<div><p>{LONG}</p></div><article><a href=/x>Read more</a></article>")) == LONG


def test_links_around_blocks():
    inside = H.blocks(f"<div><a href=/x><p>{LONG}</p></a><p>{LONG}</p></div>")
    assert [b.link_chars for b in inside] == [len(LONG), 0]


def test_form_around_the_whole_page():
    assert H.main_text(page(f"<form><nav>menu</nav><main><p>{LONG}</p></main></form>")) == LONG


def test_articles_without_good_text_leave_the_rest():
    assert H.main_text(page(f"<div id=content><p>{LONG}</p></div><article class=card><a href=x>Next story</a></article>")) == LONG
    assert H.main_text(page(f"<div id=content><p>{LONG}</p></div><article class=card><p>Next</p></article>")).startswith(LONG)
    assert H.main_text(page(f"<p>{LONG}</p><article><p>{LONG[5:]}</p></article>")) == LONG[5:]
    assert H.main_text(page("<p>Out</p><article><p>One</p><p>Two</p></article>")) == "One\n\nTwo"


def test_wrappers_named_for_what_else_they_hold():
    for name in ("page-with-sidebar", "content-with-sidebar", "wp-has-sidebar", "main-no-sidebar", "page_no_sidebar"):
        assert H.main_text(page(f"<div class={name}><p>{LONG}</p></div>")) == LONG, name
    for name in ("left-sidebar", "sidebar-with-ads", "left-sidebar-with-ads", "site_footer"):
        assert H.main_text(page(f"<div class={name}><p>{LONG}</p></div>")) == "", name
    for tag in ("main", "article"):
        assert H.main_text(page(f"<div class=content-sidebar-wrap><div><{tag}><p>{LONG}</p></{tag}></div><p>Side {LONG}</p></div>")) == LONG
        for bad in ("<aside>", "<div role=dialog>", "<div class=sidebar><nav>"):
            assert H.main_text(page(f"{bad}<{tag}><p>{LONG}</p></{tag}>")) == ""
    assert H.main_text(page(f"<div class=related-posts><article class=post><p>{LONG}</p></article></div>")) == ""


def test_languages_without_known_stop_words():
    polish = "Wczoraj wieczorem nad rzeką zebrali się mieszkańcy wszystkich okolicznych wsi, ponieważ burmistrz obiecał przedstawić nowy plan ochrony przed powodzią. "
    chinese = "昨天晚上，附近所有村庄的居民都聚集在河边，因为市长答应介绍新的防洪计划。" * 6
    for text in (polish * 2, chinese):
        html = page(f"<div><a href=1>{text[:80]}</a></div><div class=body><p>{text.strip()}</p><p>{text[:90].strip()}</p></div><footer>{text}</footer>")
        assert H.main_text(html).split("\n\n") == [text.strip(), text[:90].strip()]
    assert H.main_text(page(f"<p>{LONG}</p><p>{'zq ' * 30}</p>")) == LONG, "among known text it is still junk"


def test_broken_markup():
    for html in (None, "", "<", "<a", '<a "', "<!--", "</", "<p", "&#xZZ;", "<div><div><div>", "</div></p>", "<script>", "a < b & c", "<p>" * 3000, "<span>" * 3000, "\x00"):
        assert isinstance(H.main_text(html), str)
    assert H.main_text("<p>1 < 2 &lt;b&gt; &amp;amp;</p>") == "1 < 2 <b> &amp;"


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>")), (1, None, None), (None, "v", ""), (2, "w", page("<article><p>é</p></article>")), (3, "x", "<p>" + "word of the " * 60_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in H.extract(table).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, u, H.main_text(h), len(H.main_text(h)))) for i, u, h in rows)
    assert H.extract(table.limit(0)).count() == 0 and H.main_text(rows[3][2]) == "é"


def test_names_of_articles_are_read_whole():
    """A word in an article's class or id says what else it has, or what it is about."""
    text = "This is the text of an article that is about something and has all that a reader could want of it. " * 4
    for mark in ('article class="post has-comments"', 'article class="post no-ads"', 'main class="with-ads"', 'article id="comment-on-the-state-of-art"', 'article id="ad-policy-explained"'):
        page = f"<body><{mark}><p>{text}</p></{mark.split()[0]}><div><p>x</p></div></body>"
        assert html_extract.main_text(page) == text.strip(), mark
    for mark in ("comments", "comment-list", "related-posts", "teaser"):
        page = f'<body><article><p>{text}</p></article><article class="{mark}"><p>{text[:300]} other</p></article></body>'
        assert html_extract.main_text(page) == text.strip(), mark


def test_what_is_unread_in_a_line_does_not_cut_it():
    cases = {
        "<p>Press <button>OK</button> to go on.</p>": "Press to go on.",
        "<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is one.</p>": "Where x=1 is one.",
        "<p>Where <math>x</math> is one.</p>": "Where x is one.",
        "<p>A <svg><text>drawn</text></svg> picture <progress>50 %</progress> in a line <object>none</object> here.</p>": "A picture in a line here.",
    }
    for html, text in cases.items():
        assert [b.text for b in html_extract.blocks(html)] == [text]
