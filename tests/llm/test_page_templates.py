"""Main text of generated pages against a plain walk over their marked articles."""

import random
from html.parser import HTMLParser

import pytest

from versehall.llm import consensus_html

LONG = "A sentence of the article that is long enough. " * 8


class Marked(HTMLParser):
    """The text of the element that is marked data-main, block by block: a plain walk of well-formed pages."""

    INLINE = {"b", "i", "a", "span", "em", "math", "mi", "mo", "mn"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.depth or any(k == "data-main" for k, _ in attrs):
            self.depth += 1
            if tag not in self.INLINE:
                self.blocks.append("")

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= 1
            if tag not in self.INLINE:
                self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def texts(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", html) for i, (host, html) in enumerate(pages)]
    got = consensus_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.text for r in got.orderBy("page_id").collect()]


def test_wrappers_named_by_unwanted_words(spark):
    names = ["post sidebar-left", "content toc-enabled", "article social-science", "layout fixed-header", "page has-sidebar comments-open", "story sponsored-content", "post sidebar", "search-engine-history", "related-work", "no-comments skip-lines"]
    pages = [("one", f'<body><div class="{c}"><h1>Title</h1><p>{LONG}</p></div></body>') for c in names]
    pages += [("two", f'<body><div id="{c.split()[0]}-nav-layout"><p>{LONG}</p><div class="nav-left"><p>menu</p></div></div></body>') for c in names]
    want = [f"Title\n{LONG.strip()}"] * len(names) + [LONG.strip()] * len(names)
    assert texts(spark, pages) == want


def test_unwanted_parts_stay_out(spark):
    parts = ["sidebar", "sidebar-left", "cookie-banner", "comments", "comments-area", "comment-list", "related-posts", "site-footer", "top-nav", "ads ads-wide"]
    pages = [("h", f'<body><div class="post"><p>{LONG}</p></div><div class="{c}"><p>{"These words do not belong. " * (30 if "comment" in c else 3)}</p></div></body>') for c in parts]
    assert texts(spark, pages) == [LONG.strip()] * len(parts)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>Euler <math><mi>e</mi><mo>=</mo><mn>1</mn><annotation>e</annotation></math> holds</p>", "Euler e=1 holds"),
        ("< 5 kg and more words", "< 5 kg and more words"),
        ("<p>less <", "less <"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p title=it's>Second don't paragraph.</p><p>Third isn't.</p>", "Second don't paragraph.\nThird isn't."),
        ("<p title='a>b' data-x=\"c>d\" e = f>Quoted.</p>", "Quoted."),
        ("<p class=x'hidden y='hidden'>Shown.</p>", "Shown."),
        ('<p title="open>never closed</p>', "never closed"),
        ("<p a=>Empty value.</p><p =b>Odd name.</p>", "Empty value.\nOdd name."),
    ],
)
def test_markup_as_it_comes(spark, html, want):
    page = consensus_html.Page(html)
    assert page.text(page.best()) == want


def test_generated_templates(spark):
    """Two hundred templates of three pages: wrappers with random names, unwanted words among them,
    boilerplate around and inside, articles of many kinds of blocks."""
    rng = random.Random(11)
    lorem = "lorem ipsum dolor sit amet elit sed do eiusmod tempor".split()
    words = lambda n: " ".join(rng.choice(lorem) for _ in range(n)).capitalize() + "."
    good = ["post", "entry", "content", "story", "text-body", "main-col", "col8", "wrap", "x7"]
    odd = ["sidebar-left", "toc-enabled", "social-science", "header-fixed", "has-sidebar", "comments-open", "adsense-free", "menu-collapsed", "sticky-footer", "widget-ready"]
    junk = [
        lambda: f"<nav><ul><li><a href=/>{words(2)}</a></li></ul></nav>", lambda: f"<aside><p>{words(12)}</p></aside>", lambda: f"<div class='cookie-banner'>{words(8)}</div>",
        lambda: f"<div id='comments-area'><h3>{words(2)}</h3><p>{words(90)}</p></div>", lambda: f"<footer>{words(9)}</footer>", lambda: f"<div class='sidebar-right'><p>{words(6)}</p></div>",
        lambda: f"<form><input><button>{words(2)}</button></form>", lambda: f"<script>var a = '<p>{words(5)}</p>';</script>", lambda: "",
    ]
    inline = [lambda x: x, lambda x: f"<b>{x[:9]}</b>{x[9:]}", lambda x: f"{x} <math><mi>e</mi><mo>=</mo></math> <i>{words(3)}</i>", lambda x: f"{x} &lt; &amp; < 5 don't"]
    pages, want = [], []
    for t in range(200):
        shells = [(rng.choice(["div", "section", "div"]), " ".join(rng.sample(good, rng.randint(0, 2)) + rng.sample(odd, rng.randint(0, 2)))) for _ in range(rng.randint(1, 4))]
        box = rng.choice(["div", "div", "article", "main", "section", "td"])
        name, sides = " ".join(rng.sample(good, 1) + rng.sample(odd, rng.randint(0, 1))), [rng.choice(junk) for _ in range(4)]
        for _ in range(3):
            kinds = ["h1"] + [rng.choice(["p", "p", "p", "h2", "blockquote", "pre", "ul"]) for _ in range(rng.randint(3, 7))]
            blocks = "\n".join(f"<ul><li>{words(14)}</li><li>{words(15)}</li></ul>" if k == "ul" else f"<{k} title=it's>{rng.choice(inline)(words(rng.randint(15, 30)))}</{k}>" for k in kinds)
            body = f"<{box} class='{name}' data-main>{blocks}</{box}>"
            body = f"<table><tr>{body}</tr></table>" if box == "td" else body
            for tag, c in shells:
                body = f"<{tag} class='{c}'>{body}</{tag}>"
            html = f"<html><head><title>{words(2)}</title></head><body>{sides[0]()}{sides[1]()}{body}{sides[2]()}{sides[3]()}</body></html>"
            pages.append((f"t{t}", html))
            want.append(Marked(html).text())
    got = texts(spark, pages)
    missed = [i for i, (g, w) in enumerate(zip(got, want)) if g != w]
    assert not missed, (len(missed), pages[missed[0]], got[missed[0]], want[missed[0]])
