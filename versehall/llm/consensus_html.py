"""Main text of web pages by consensus host paths.

Every page's containers are scored by their running text; the best one's generalised path (tags and
class names without digits) is its page's vote. Votes are summed per host and path in Spark, and
each page's text is then taken from all elements of its host's winning path, or from its own best
container where it has no such element. Where these miss headings or paragraphs of the page's own
container, that is added if the page's top heading is among them or other pages of the host vote
for the same container; a page alone in this keeps to its host's path.

The pass over a page and the choice of its container take time in proportion to the page, however
deep its elements are nested: open elements are counted by name, a path is a parent and a step, and
subtrees that hold too little are passed over whole.

Menus, notices and the like are known by their elements and by names in class, id and role. A name of
nothing but such words ("sidebar", "cookie-banner") is believed, also "comments-area"; a word in a longer name ("sidebar-left",
"toc-enabled", "social-science") or beside a name of content ("post sidebar") only where the element holds less than a
third of the page's running text, so that a wrapper around the article is never dropped for a word.

Defined cases: formulas (`math`) are text, but not their annotations; an attribute's value without quotes ends at
white space or `>`; a `<` that begins no tag is text; null or blank html gives an empty text; broken and cut-off markup is read as far as
it goes; of paths with equal votes (to 6 decimals) the greater in code point order wins, of equally good elements
the first; a page without a host (null or odd url) votes for the empty host; repeated rows give
repeated results and vote as often; an empty table an empty result; other columns of the pages play
no part.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versehall.llm.common import attach, in_arrow, stage

# Element kinds of HTML, and words that name parts of a page in class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = {"article", "main", "section", "div", "td", "center", "body", "blockquote"}
SKIPPED = set("head nav footer aside form script style noscript template iframe svg annotation annotation-xml button select textarea input object dialog menu canvas audio video map datalist".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNWANTED = set(
    "nav navbar navigation menu sidebar aside footer header masthead ad ads advert adverts advertisement adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices alert alerts comment comments commentlist disqus reply replies respond share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay "
    "widget pagination pager toolbar copyright skip contentinfo complementary search toc".split()
)
EXCEPT = {"has", "with", "no", "without"}
CONTENT = set("article body container content entry layout main page post story text wrap wrapper".split())
TALK = set("comment comments commentlist disqus reply replies respond".split())  # parts whose text may be longer than the article
FRAME = set("area block body box container content form inner list region section thread wrap wrapper".split())
LITTLE = 1 / 3  # of the page's running text: an element that is unwanted by a word in a longer name holds less
CLOSES = {  # elements that a start tag ends when they are open right above
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": set(), "tfoot": {"tr", "td", "th", "tbody"},
}
SEPARATOR = "\n"  # of a path's steps; labels hold no white space
PARAGRAPHS = {"p", "blockquote", "pre"}
SENTENCE = 10  # words that make a block of any other kind a paragraph
SHARE = 0.6  # of the parent's running text that makes a container the better one

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|xmp|noscript|iframe)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=20_000)
def _about(attrs: str) -> tuple[str, str]:
    """(generalised class and id, verdict) of an attribute text. Verdicts: "skip" and "head" (only
    headings count) for what a whole name says or what is hidden; "soft" and "softhead" for a word in a longer name
    or beside a name of content, which may as well say something about what the element holds."""
    named = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    names = named.get("class", "").split() + [named[k] for k in ("id", "role") if named.get(k)]
    label = "".join(sorted({"." + x for x in (re.sub(r"\d+", "", c.lower()).strip("-_") for c in named.get("class", "").split()) if x}))
    if named.get("id") and not re.search(r"\d", named["id"]):
        label += "#" + "".join(named["id"].lower().split())
    parts = [{w.lower() for w in _PART.findall(name)} for name in names]
    content = any(words & CONTENT and not words & UNWANTED for words in parts)
    found = set()
    for words in parts:
        bad = words & UNWANTED
        if bad and not words & EXCEPT:
            rest = words - bad
            alone = not content and (not rest or (bool(bad & TALK) and rest <= FRAME))
            found.add(("head" if alone else "softhead") if bad == {"header"} else "skip" if alone else "soft")
    verdict = next((v for v in ("skip", "soft", "head", "softhead") if v in found), "")
    bare = _ATTR.sub(" ", attrs)
    if re.search(r"\bhidden\b(?!\s*=)", bare) or named.get("hidden") is not None or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")):
        verdict = "skip"
    return label, verdict


class Page:
    """Elements in document order with the text runs that may count, from one tolerant pass."""

    def __init__(self, html: str):
        self.tags, self.steps, self.ends, self.parents, self.blocks = ["#"], [(-1, "")], [0], [0], [0]
        self.path_of = [0]  # of each element: the place of its path in `steps`
        self._steps: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, int, str, bool]] = []  # element, block, text, inside a link
        self.verdicts = [""]
        open_, block, at = [0], 0, 0
        links, names, walls = 0, Counter(), []  # open elements by name; places of the open blocks in `open_`

        def shut(to: int) -> None:
            """Close the open elements from place `to` on."""
            nonlocal block, links
            while len(open_) > to:
                i = open_.pop()
                self.ends[i] = len(self.tags)
                names[self.tags[i]] -= 1
                links -= self.tags[i] == "a"
                if walls and walls[-1] == len(open_):
                    walls.pop()

        for m in _TAG.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()], open_, block, links)
            at = m.end()
            name = m["name"]
            if not name:
                continue
            tag = name.lower()
            if m["end"]:
                if names[tag] > 0:
                    k = len(open_) - 1
                    while self.tags[open_[k]] != tag:
                        k -= 1
                    block += sum(self.tags[i] in BLOCKS for i in open_[k:])
                    shut(k)
                elif tag == "p":
                    block += 1
                continue
            if tag in BLOCKS:
                block += 1
                closed = ({"p"} if tag != "option" else {"option"}) | CLOSES.get(tag, set())
                # a block ends an open paragraph and what it left open inside
                while walls and self.tags[open_[walls[-1]]] in closed:
                    shut(walls[-1])
            elif tag == "br":
                self._text(" ", open_, block, links)
            if tag in VOID:
                continue
            up, attrs = open_[-1], m["attrs"]
            label, verdict = _about(attrs) if attrs and tag not in ("a", "p", "b", "i", "span", "li", "img") or "hidden" in attrs or "none" in attrs or "class" in attrs else ("", "")
            if tag in SKIPPED:
                verdict = "skip"
            elif tag in ("html", "body", "main", "article"):
                verdict = ""
            elif tag == "header" and verdict != "skip":
                verdict = "head"
            if not attrs.endswith("/") or tag in BLOCKS or tag == "a":
                links += tag == "a"
                names[tag] += 1
                if tag in BLOCKS:
                    walls.append(len(open_))
                open_.append(len(self.tags))
                self.verdicts.append(verdict)
                self.blocks.append(len(self.tags) if tag in BLOCKS else self.blocks[up])
                self.tags.append(tag)
                self.parents.append(up)
                self.path_of.append(self._step(self.path_of[up], f"{tag}{label}") if tag in CONTAINERS else self.path_of[up])
                self.ends.append(-1)
        if at < len(html):
            self._text(html[at:], open_, block, links)
        for i, end in enumerate(self.ends):
            if end < 0 or not i:
                self.ends[i] = len(self.tags)
        every = self.runs
        self._keep(every, {"soft": "", "softhead": ""})
        if "soft" in self.verdicts or "softhead" in self.verdicts:
            little = self.good[0] * LITTLE
            self.verdicts = [v if not v.startswith("soft") else "" if self.good[i] >= little > 0 else {"soft": "skip"}.get(v, "head") for i, v in enumerate(self.verdicts)]
            self._keep(every, {})

    def _keep(self, runs: list[tuple[int, int, str, bool]], as_: dict[str, str]) -> None:
        """Keep the runs that count, and sum the running text of every element. An element's state: ""
        wanted, "skip", "head" (headings only), "in" (wanted, inside an article)."""
        state = [""]
        for i in range(1, len(self.tags)):
            kind, verdict, tag = state[self.parents[i]], self.verdicts[i], self.tags[i]
            verdict = as_.get(verdict, verdict)
            if kind == "skip" or verdict == "skip":
                state.append("skip")
            elif kind == "head" or verdict == "head":
                inside = kind == "in" or kind == "head"
                state.append("in" if inside and tag in HEADINGS else "head" if inside else "skip")
            else:
                state.append("in" if tag in ("article", "main") else kind)
        self.runs = [r for r in runs if state[r[0]] not in ("skip", "head")]
        self.good = [0] * len(self.tags)
        for i, _, text, link in self.runs:
            if not link:
                self.good[i] += len(text.strip())
        for i in range(len(self.tags) - 1, 0, -1):
            self.good[self.parents[i]] += self.good[i]

    def _step(self, path: int, step: str) -> int:
        known = self._steps.get((path, step))
        if known is None:
            known = self._steps[path, step] = len(self.steps)
            self.steps.append((path, step))
        return known

    def path(self, i: int) -> str:
        """An element's path: its containers' steps."""
        out, at = [], self.path_of[i]
        while at:
            at, step = self.steps[at]
            out.append(step)
        return "".join(SEPARATOR + x for x in reversed(out))

    def _place(self, path: str) -> int | None:
        """The place of a path in `steps`, if the page has it."""
        at: int | None = 0
        for step in path.split(SEPARATOR)[1:]:
            at = self._steps.get((at, step))
            if at is None:
                return None
        return at

    def _text(self, raw: str, open_: list[int], block: int, links: int) -> None:
        self.runs.append((open_[-1], block, entities.unescape(raw) if "&" in raw else raw, links > 0))

    def best(self) -> int:
        """The container of the main text: an article that holds most of it, else the deepest
        container that holds SHARE of its parent's running text and all its headings and paragraphs."""
        total = self.good[0]
        for tag in ("article", "main"):
            own = [i for i, t in enumerate(self.tags) if t == tag]
            if own and total:
                i = max(own, key=lambda i: (self.good[i], -i))
                if self.good[i] >= SHARE * sum(self.good[j] for j in own if self.parents[j] != i) and self.good[i] >= total / 4:
                    return i
        at, i = 0, 1
        while i < self.ends[at]:
            if self.good[i] < SHARE * self.good[at] or not self.good[at]:
                i = self.ends[i]  # nothing in it can hold the share
            elif self.tags[i] not in CONTAINERS or self.tags[i] == "blockquote":
                i += 1
            elif self.wanted(i) < self.wanted(at):
                break
            else:
                at, i = i, i + 1
        return at

    @cached_property
    def kept(self) -> list[tuple[int, int]]:
        """(element, heading level or 7) of the blocks that are headings or paragraphs, not links."""
        blocks: dict[int, list] = {}
        for i, block, text, link in self.runs:
            b = blocks.setdefault(block, [i, [], 0])
            if link:
                b[2] += len(text.strip())
            else:
                b[1].append(text)
        out = []
        for i, parts, links in blocks.values():
            own, tag = "".join(parts), self.tags[self.blocks[i]]
            if tag in HEADINGS and (links or own.strip()):
                out.append((i, int(tag[1])))
            elif len(own.strip()) > links and (tag in PARAGRAPHS or len(own.split()) >= SENTENCE):
                out.append((i, 7))
        return out

    @cached_property
    def _places(self) -> list[int]:
        return sorted(i for i, _ in self.kept)

    def wanted(self, *ats: int) -> int:
        """How many headings and paragraphs stand in these elements."""
        at, n, upto = self._places, 0, 0
        for i in sorted(ats, key=lambda i: (i, -self.ends[i])):
            if self.ends[i] > upto:  # elements lie in one another or apart
                n += bisect_left(at, self.ends[i]) - bisect_left(at, i)
                upto = self.ends[i]
        return n

    def _inside(self, ats: tuple[int, ...]) -> bytearray:
        """1 for every element within these."""
        out = bytearray(len(self.tags))
        for at in ats:
            out[at : self.ends[at]] = b"\1" * (self.ends[at] - at)
        return out

    def at_path(self, path: str) -> list[int]:
        """The elements of that path: the one with most running text, and all with headings or paragraphs."""
        place = self._place(path)
        found = [i for i, p in enumerate(self.path_of) if p == place and self.tags[i] in CONTAINERS]
        if len(found) < 2:
            return found
        most, at = max(found, key=lambda i: (self.good[i], -i)), self._places
        return [i for i in found if i == most or bisect_left(at, i) < bisect_left(at, self.ends[i])]

    def choose(self, path: str | None) -> tuple[str, str | None, str]:
        """The text by the host's path; the text with the page's own container where the host's
        votes for that one have to decide; that container's path."""
        own = self.best()
        ats = self.at_path(path) if path else []
        if not ats or sum(self.good[i] for i in ats) < self.good[own] / 10:  # another template's element
            return self.text(own), None, self.path(own)
        if own in ats or self.wanted(own, *ats) == self.wanted(*ats):
            return self.text(*ats), None, self.path(own)
        top = min(self.kept, key=lambda k: k[1])
        if top[1] < 7 and self._inside((own,))[top[0]] and not self._inside(tuple(ats))[top[0]]:
            return self.text(own, *ats), None, self.path(own)
        return self.text(*ats), self.text(own, *ats), self.path(own)

    def text(self, *ats: int) -> str:
        """Text of elements: blocks in order, joined by newlines, their white space single."""
        out, last, parts, inside = [], None, [], self._inside(ats)
        for i, block, text, _ in self.runs:
            if not inside[i]:
                continue
            if block != last:
                out.append("".join(parts))
                last, parts = block, []
            parts.append(text)
        out.append("".join(parts))
        return "\n".join(x for x in (" ".join(o.split()) for o in out) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def vote(part: dict) -> dict:
        paths, weight = [], []
        for html in part["html"]:
            page = Page(html or "")
            at = page.best()
            paths.append(page.path(at))
            weight.append(page.good[at] / page.good[0] if page.good[0] else 0.0)
        return {"host": part["host"], "path": paths, "weight": weight}

    votes = in_arrow(rows.select("host", "html"), vote, "host string, path string, weight double")
    tally = stage(votes.groupBy("host", "path").agg(F.sum("weight").alias("votes"), F.count("*").alias("n")), "host-votes")
    ranked = F.struct(F.round("votes", 6).alias("votes"), "path")
    won = stage(tally.groupBy("host").agg(F.max(ranked).alias("r")).select("host", F.col("r.path").alias("path")), "host-paths")
    shared = tally.where("n > 1").select(F.xxhash64("host", "path").alias("vote"), F.lit(True).alias("shared")).distinct()

    def take(part: dict) -> dict:
        got = [Page(html or "").choose(path) for html, path in zip(part["html"], part["path"])]
        return {"page_id": part["page_id"], "url": part["url"], "host": part["host"], "own": [g[2] for g in got], "text": [g[0] for g in got], "whole": [g[1] for g in got]}

    kinds = dict(pages.dtypes)
    fields = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, own string, text string, whole string"
    # a host of its own size: beyond a broadcast its pages are dealt out by a salt, too
    placed = attach(rows, won, "host", F.col("html")).select("page_id", "url", "html", "host", "path")
    both = in_arrow(placed, take, fields).withColumn("vote", F.xxhash64("host", "own"))
    text = F.when(F.col("shared"), F.coalesce("whole", "text")).otherwise(F.col("text"))
    both = attach(both, shared, "vote", F.col("text"))
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
