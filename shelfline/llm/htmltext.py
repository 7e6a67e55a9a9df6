"""The main text of web pages, by scoring the tree of their elements.

A page is read as browsers do where that matters for text: raw content of scripts and styles, comments, tags that are never
closed, tags that close others, quoted attributes. What a tag, a role, a class or an id names as page furniture (menu, header, footer,
sidebar, notice, advert, form, comments of readers) is left out with all it holds. The remaining text is cut into blocks at
the borders of block elements. Each block passes points for its length and its commas to the element that holds it, half of
that to the next ancestor and so on; an element's sum is discounted by the share of its text that lies in links. The element
with the most points is kept with its siblings of like score and its neighbouring paragraphs and headings. An article that holds the
best element takes its place, so that its heading is not lost.

Text: character references are decoded, white space within a block (a line break of the page too) becomes one space, blocks are
trimmed and joined in page order by one line feed. A null, empty or textless page has the empty text. Repeated rows are extracted each
for itself. Time and memory grow with the length of the page, whatever its nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import map_slices, whole_text

#: Elements by their role in the standard.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li dt dd td th caption figcaption summary legend tr".split())
#: Elements beyond which a tag closes nothing.
BARRIERS = frozenset("table td th caption button object template marquee".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th caption".split())
#: Inline elements that matter for what they hold.
NESTED = frozenset("a svg math".split())
#: What the start of an element closes, and the elements beyond which it does not look.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "td": (frozenset("td th caption".split()), frozenset(["table"])),
    "th": (frozenset("td th caption".split()), frozenset(["table"])),
    "tr": (frozenset("tr caption".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
}
#: What is not part of an article, by tag, by role, and by the words of a class or an id.
OUT_TAGS = frozenset(
    "script style xmp iframe noembed noframes title textarea noscript template nav footer aside form fieldset button select "
    "datalist option optgroup object applet canvas svg audio video map dialog menu search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner outbrain taboola "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup paywall login "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc skip "
    "sidebar aside rail footer masthead topbar toolbar widget widgets "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations teaser teasers hidden".split())
#: A word after one of these says something about the element's surroundings.
ABOUT = frozenset("has with without no".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())

#: Points that an element has from the start if its tag or a class says that it holds the article.
NAMED_POINTS = 25.0
#: Points of a block: one, one for each comma, and one for so many characters.
POINT_CHARS = 100
COMMAS = re.compile("[,،、，]")
#: A sibling is kept from this share of the best score on, but from so many points at least.
SIBLING_SHARE, SIBLING_POINTS = 0.2, 10.0
#: A neighbouring paragraph is kept if it is longer than this with few links, or shorter, without links, and a sentence.
SENTENCE_CHARS, FEW_LINKS = 80, 0.25
#: Within what is kept, an element of so many links or more that holds little else is a menu.
MENU_LINKS, MENU_DENSITY = 3, 0.8

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
TAG_END = re.compile(r"[\s/]*>")
COMMENT_END = re.compile(r"--!?>")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def named_words(tag: str, attributes: dict[str, str]) -> list[str]:
    """The words of the class, and but for paragraphs and headings of the id, that speak of the element itself."""
    words: list[str] = []
    for name in ("class",) if tag in PARAGRAPHS else ("class", "id"):
        for part in attributes.get(name, "").split():
            found = WORD.findall(CAMEL.sub(" ", part).lower())
            words += [w for n, w in enumerate(found) if not n or found[n - 1] not in ABOUT]
    return words


class Page:
    """Block elements by number, parents first, and the blocks of text that they hold."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.named = [-1], ["body"], [0.0]
        self.owner: list[int] = []
        self.text: list[str] = []
        self.link_chars: list[int] = []
        self.links: list[int] = []
        self.stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # tag, number of its block element, left out
        self.open: Counter = Counter()
        self.scope: Counter = Counter()  # what is open since the last barrier
        self.outer: list[Counter] = []
        self.pieces: list[tuple[str, bool]] = []
        self.starts_links = 0
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            start = html.find("<", at)
            if start < 0:
                start = end
            if start > at:
                self.characters(unescape(html[at:start]))
            if start == end:
                return
            at = self.markup(html, start)

    def markup(self, html: str, start: int) -> int:
        """Read what begins with < at start; returns where it ends."""
        if not (found := TAG.match(html, start)):
            if html.startswith("<!--", start):
                if html.startswith((">", "->"), start + 4):
                    return html.index(">", start) + 1
                closed = COMMENT_END.search(html, start + 4)
                return closed.end() if closed else len(html)
            if html.startswith(("<!", "<?", "</"), start):
                return html.find(">", start) + 1 or len(html)
            self.characters("<")
            return start + 1
        tag, at, attributes = found[2].lower(), found.end(), {}
        while not (closed := TAG_END.match(html, at)):
            if not (part := ATTRIBUTE.match(html, at)) or part.end() == len(html):
                return len(html)  # the page ends within the tag
            value = part[2] or ""
            attributes.setdefault(part[1].lower(), unescape(value.strip(value[0])) if value[:1] in ("'", '"') else unescape(value))
            at = part.end()
        if found[1]:
            self.end_tag(tag)
            return closed.end()
        self.start_tag(tag, attributes, "/" in closed[0])
        if tag not in RAW or self.stack[-1][0] != tag:
            return closed.end()
        raw_end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, closed.end())
        return raw_end.start() if raw_end else len(html)

    def characters(self, text: str) -> None:
        if not self.stack[-1][2]:
            self.pieces.append((text, self.open["a"] > 0))

    def start_tag(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in ("br", "hr"):
            self.characters(" ")
        if tag in BLOCKS:
            if self.scope["p"]:
                self.close(frozenset(["p"]), BARRIERS)
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self.pop()
            self.flush()
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in VOID:
            return
        if tag == "a":
            self.end_link()
        _, holder, out = self.stack[-1]
        out = out or self.is_out(tag, attributes)
        if tag in BLOCKS and not out:
            words = ARTICLE_WORDS.intersection(named_words(tag, attributes)) if tag not in PARAGRAPHS else ()
            self.parent.append(holder)
            self.tag.append(tag)
            self.named.append(NAMED_POINTS if tag in ("article", "main") or words else 0.0)
            holder = len(self.parent) - 1
        if closed and (self.open["svg"] or self.open["math"]):
            return
        if tag == "a" and not out:
            self.starts_links += 1
        if tag in BLOCKS or tag in BARRIERS or tag in NESTED or out:  # others change nothing
            self.stack.append((tag, holder, out))
            self.open[tag] += 1
            self.scope[tag] += 1
            if tag in BARRIERS:
                self.outer.append(self.scope)
                self.scope = Counter()

    def is_out(self, tag: str, attributes: dict[str, str]) -> bool:
        inside = self.open["article"] or self.open["main"]
        if tag in OUT_TAGS or tag == "header" and not inside:
            return True
        if tag == "main" or not attributes:
            return False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
            return True
        if attributes.get("role", "").lower() in OUT_ROLES:
            return True
        words = named_words(tag, attributes)
        return not OUT_WORDS.isdisjoint(words) or "header" in words and not inside and ARTICLE_WORDS.isdisjoint(words)

    def end_tag(self, tag: str) -> None:
        if tag == "a":
            self.end_link()
        elif not self.open[tag]:
            return
        elif tag in HEADINGS:
            self.close(HEADINGS, BARRIERS)
        elif tag in TABLE_PARTS or tag in BARRIERS:
            self.close(frozenset([tag]), frozenset(["table"]))
        elif tag in BLOCKS:
            if self.scope[tag]:
                self.close(frozenset([tag]), BARRIERS)
        else:
            self.close(frozenset([tag]), BLOCKS | BARRIERS)

    def end_link(self) -> None:
        """End the open link, also if elements that began within it are still open."""
        if self.scope["a"]:
            at = next(n for n in range(len(self.stack) - 1, 0, -1) if self.stack[n][0] == "a")
            self.stack[at] = ("", *self.stack[at][1:])
            self.open["a"] -= 1
            self.scope["a"] -= 1
            while not self.stack[-1][0]:
                self.stack.pop()

    def close(self, tags: frozenset[str], beyond: frozenset[str]) -> None:
        """End the nearest open element of these tags with all that is open within it, unless one of beyond lies between."""
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at][0]
            if tag in tags:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in beyond:
                return

    def pop(self) -> None:
        tag = self.stack[-1][0]
        if tag in BLOCKS:
            self.flush()
        if tag in BARRIERS:
            self.scope = self.outer.pop()
        self.stack.pop()
        self.open[tag] -= 1
        self.scope[tag] -= 1

    def flush(self) -> None:
        """The pieces since the last border of a block are a block of the innermost block element."""
        if self.pieces:
            if text := " ".join("".join(x for x, _ in self.pieces).split()):
                self.owner.append(self.stack[-1][1])
                self.text.append(text)
                self.link_chars.append(min(len(text), sum(len(" ".join(x.split())) for x, linked in self.pieces if linked)))
                self.links.append(self.starts_links)
            self.pieces = []
        self.starts_links = 0

    def main_text(self) -> str:
        """The blocks of the best element and of what belongs to it."""
        if not self.text:
            return ""
        number = len(self.parent)
        points, chars, in_links, links = self.named[:], [0] * number, [0] * number, [0] * number
        passed = [0.0] * number
        for owner, text, linked, starts in zip(self.owner, self.text, self.link_chars, self.links, strict=True):
            chars[owner] += len(text)
            in_links[owner] += linked
            links[owner] += starts
            if self.tag[owner] not in HEADINGS:
                own = 1 + len(COMMAS.findall(text)) + len(text) / POINT_CHARS
                holder = self.parent[owner] if self.tag[owner] in PARAGRAPHS else owner
                points[holder] += own
                passed[holder] += own
        for n in range(number - 1, 0, -1):  # children have higher numbers than their parents
            up = self.parent[n]
            points[up] += passed[n] / 2
            passed[up] += passed[n] / 2
            chars[up] += chars[n]
            in_links[up] += in_links[n]
            links[up] += links[n]
        density = [a / max(b, 1) for a, b in zip(in_links, chars, strict=True)]
        score = [p * (1 - d) if c else -1.0 for p, d, c in zip(points, density, chars, strict=True)]
        best = max(range(number), key=lambda n: (score[n], -n))
        holder = best
        while holder and self.tag[holder] != "article":
            holder = self.parent[holder]
        best = holder or best
        keep = self.with_siblings(best, score, chars, density)
        for n in range(1, number):
            if keep[self.parent[n]] and n != best:
                keep[n] = keep[n] or not (links[n] >= MENU_LINKS and density[n] >= MENU_DENSITY)
        around = self.parent[best]
        return "\n".join(text for owner, text, linked in zip(self.owner, self.text, self.link_chars, strict=True)
                         if keep[owner] or owner == around and is_prose(text, linked / len(text)))

    def with_siblings(self, best: int, score: list[float], chars: list[int], density: list[float]) -> list[bool]:
        keep = [False] * len(score)
        keep[best] = True
        least = max(SIBLING_POINTS, SIBLING_SHARE * score[best])
        whole: dict[int, list[str]] = {}
        for owner, text in zip(self.owner, self.text, strict=True):
            if self.parent[owner] == self.parent[best] and self.tag[owner] in PARAGRAPHS:
                whole.setdefault(owner, []).append(text)
        for n in range(1, len(score)):
            if best and n != best and self.parent[n] == self.parent[best] and chars[n]:
                heading = self.tag[n] in HEADINGS and density[n] < FEW_LINKS
                keep[n] = heading or score[n] >= least or n in whole and is_prose(" ".join(whole[n]), density[n])
        return keep


def is_prose(text: str, density: float) -> bool:
    return density < FEW_LINKS if len(text) > SENTENCE_CHARS else density == 0 and bool(SENTENCE.search(text))


def main_text(html: str) -> str:
    return Page(html).main_text()


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Columns key, url, text and n_chars (its code points), one row per row of pages."""
    kind = dict(pages.dtypes)

    def work(part: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        return {"key": part.column("key"), "url": part.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), whole_text(html).alias("html"))
    found = map_slices(rows, work, f"key {kind[key]}, url {kind[url]}, text string, n_chars bigint", rows=64)
    return found.withColumnsRenamed({"key": key, "url": url})
