"""Main text of web pages by scoring the tree of elements.

Parts that say by tag, role, class or state that they are no article are left
out.  Each paragraph passes points, for its length and its commas and less for
links, to its parent, half to the grandparent and so on; a container loses the
share of its text that is links.  The best container is kept with the siblings
that score or read like it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import spread

#: Elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template title textarea iframe object audio video canvas svg math select button input label fieldset legend datalist option nav footer aside menu dialog xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open one of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}),
    "main": ({"nav", "header", "footer", "aside"}, set()), "article": ({"nav", "header"}, set()),
}
CELLS = frozenset({"td", "th", "caption"})
#: Words of roles, classes and ids that tell what an element is.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip".split())
COMMENTS = frozenset("comment comments commentlist commentarea disqus discussion respond reply replies responses guestbook kommentare commentaires comentarios".split())
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adunit adbox sponsor sponsored sponsors promo promos promotion banner nav navbar navi navigation topnav subnav sidenav menu menus menubar breadcrumb breadcrumbs"
    " sidebar sidebars aside rail footer masthead topbar toolbar pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay toast lightbox newsletter subscribe subscription signup signin login paywall"
    " share sharing social related recommended recommendations trending outbrain taboola copyright search form".split()
)
UNLIKE = frozenset("has with no without not hide show".split())
CONTENT = frozenset("article articlebody content entry hentry main post story text blog".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?:\A|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop|itemtype)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMENT_HEADING = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?|leave a (?:comment|reply)", re.I)
COMMA = re.compile("[,،、，﹐︐︑︒]")

#: Shares of a paragraph's points for its parent, grandparent and so on.
SHARES = (1, 1 / 2, 1 / 3, 1 / 4, 1 / 5)
#: Characters of a full paragraph; factor for what tells of an article; from which share of the best score a sibling is kept.
FULL, BONUS, SIBLING = 25, 1.5, 0.2
#: A part of several links whose text is links by more than this share is a menu.
MENU = 0.75
#: Characters of html that a worker takes before it hands rows on.
STEP = 1 << 23
KEEP, DROP, ONLY_HEADINGS = 0, 1, 2


def _named(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """What an element's tag and attributes say: KEEP, DROP or ONLY_HEADINGS, and whether they speak of an article."""
    if tag in NEVER:
        return DROP, False
    verdict = KEEP
    if tag == "header":
        verdict = ONLY_HEADINGS if inside else DROP
    content = tag in ("article", "main")
    if not attributes or tag in ("html", "body"):
        return verdict, content
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return DROP, False
        if name == "role":
            if value.lower() in ROLES and tag != "main":
                return DROP, False
            content |= value.lower() in ("main", "article")
        elif name == "itemprop":
            content |= value == "articleBody"
        elif name == "itemtype":
            if value.endswith("Comment") or value.endswith("UserComments"):
                return DROP, False
        elif name in ("class", "id"):
            for word in value.split():
                words = {w.lower() for w in WORDS.findall(word)} - {tag}
                if words & UNLIKE:
                    continue
                if words & COMMENTS and tag != "main" or words & OTHER and tag not in ("article", "main"):
                    return DROP, False
                if "header" in words and tag not in ("article", "main"):
                    verdict = ONLY_HEADINGS if inside or words & CONTENT else DROP
                content |= bool(words & CONTENT)
    return verdict, content and verdict == KEEP


class Page:
    """The tree of a page's blocks.  Elements are numbered in page order, so a
    parent's number is below its children's; plain inline elements have none."""

    def __init__(self, html: str):
        self.tag, self.parent, self.state, self.content, self.mixed = ["#page"], [0], [KEEP], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self._read(html)

    def _read(self, html: str) -> None:
        tag, parent, state, mixed = self.tag, self.parent, self.state, self.mixed
        stack, opened, inside = [0], {}, [False]
        run: list[str] = []
        linked = links = 0
        link = -1  # the element in which a link is open

        def flush() -> None:
            nonlocal linked, links
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text)), links))
                run.clear()
            linked = links = 0

        def pop() -> None:
            nonlocal link
            flush()
            node = stack.pop()
            opened[tag[node]] -= 1
            if link == node:
                link = -1

        def said(text: str) -> None:
            nonlocal linked
            if state[stack[-1]] == KEEP:
                text = unescape(text) if "&" in text else text
                run.append(text)
                if link >= 0:
                    linked += len(text.strip())

        at, end = 0, html.rfind(">") + 1
        while m := TAG.search(html, at, end):
            if m.start() > at:
                said(html[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            dropped = state[stack[-1]] == DROP
            if name == "a":
                link = -1 if closing else stack[-1]
                links += not closing and not dropped
            if closing:
                if name in ("html", "body") or not opened.get(name):
                    continue
                k = len(stack) - 1
                while k and tag[stack[k]] != name and (tag[stack[k]] not in CELLS or name in ("table", "tr", "tbody", "thead")):
                    k -= 1
                if k and tag[stack[k]] == name:
                    while len(stack) > k:
                        pop()
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    said(" ")
                continue
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                if not close:
                    at = len(html)
                    break
                at = close.start()
                end_tag = html.find(">", at) + 1
                at = end_tag or len(html)
                continue
            verdict, content = (DROP, False) if dropped else _named(name, attributes, inside[stack[-1]])
            if name in INLINE and verdict != DROP:
                continue
            if name in ("svg", "math") and attributes.endswith("/"):
                continue
            if name not in INLINE:
                while tag[stack[-1]] in INLINE:  # left open
                    pop()
                flush()
                if tag[stack[-1]] == "p" or tag[stack[-1]] in HEADINGS and name in HEADINGS:
                    pop()
                ended, until = ENDS.get(name, (None, None))
                if ended and any(opened.get(x) for x in ended):
                    k = len(stack) - 1
                    while k and tag[stack[k]] not in ended and tag[stack[k]] not in until and (tag[stack[k]] not in CELLS or not until):
                        k -= 1
                    if k and tag[stack[k]] in ended:
                        while len(stack) > k:
                            pop()
                above = state[stack[-1]]
                if above == DROP:
                    verdict = DROP
                elif not dropped:
                    pass
                else:  # what was to be dropped has ended just now
                    verdict, content = _named(name, attributes, inside[stack[-1]])
                if above == ONLY_HEADINGS and verdict == KEEP and name not in HEADINGS:
                    verdict = ONLY_HEADINGS
                mixed[stack[-1]] = True
            tag.append(name)
            parent.append(stack[-1])
            state.append(verdict)
            self.content.append(content)
            mixed.append(False)
            inside.append(inside[stack[-1]] or content)
            stack.append(len(tag) - 1)
            opened[name] = opened.get(name, 0) + 1
        if at < len(html):
            rest = html[at:]
            cut = re.search(r"<(?:[a-zA-Z/!?]|\Z)", rest)  # a tag that the end of the page cuts off
            said(rest[: cut.start()] if cut else rest)
        flush()

    def _without(self, blocks: list, n: int) -> list:
        """Blocks without forms, unless one holds most of the page, menus, and what follows a heading of comments."""
        tag, parent = self.tag, self.parent
        chars, linked, links = [0] * n, [0] * n, [0] * n
        for node, text, inside, count in blocks:
            chars[node] += len(text)
            linked[node] += inside
            links[node] += count
        for k in range(n - 1, 0, -1):
            chars[parent[k]] += chars[k]
            linked[parent[k]] += linked[k]
            links[parent[k]] += links[k]
        out = [False] * n
        for k in range(1, n):
            out[k] = out[parent[k]] or tag[k] == "form" and 2 * chars[k] < chars[0] or links[k] > 1 and tag[k] not in ("p", "body", "html") and linked[k] > MENU * chars[k]
        kept, closed = [], set()
        for block in blocks:
            node = block[0]
            if out[node]:
                continue
            if closed:
                k = node
                while k and k not in closed:
                    k = parent[k]
                if k in closed:
                    continue
            if tag[node] in HEADINGS and COMMENT_HEADING.fullmatch(block[1]):
                closed.add(parent[node])
                continue
            kept.append(block)
        return kept

    def main_text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        blocks = self._without(self.blocks, n)
        score, chars, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, inside, _ in blocks:
            chars[node] += len(text)
            linked[node] += inside
            points = len(text) / 1000
            if tag[node] not in HEADINGS and len(text) >= FULL:
                points = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)
            points *= 1 - inside / len(text)
            at = node if self.mixed[node] or not node else parent[node]
            for share in SHARES:
                score[at] += points * share
                if not at:
                    break
                at = parent[at]
        for k in range(n - 1, 0, -1):
            chars[parent[k]] += chars[k]
            linked[parent[k]] += linked[k]
        worth = [s * BONUS if self.content[k] else s for k, s in enumerate(score)]
        worth = [w * (1 - linked[k] / chars[k]) if chars[k] else 0.0 for k, w in enumerate(worth)]
        best = max(range(n), key=lambda k: (worth[k], -k))
        if worth[best] <= 0:
            return ""
        at = best  # an article around the best container is the article
        for wanted in ("article", "main"):
            while at and tag[at] != wanted:
                at = parent[at]
            if at:
                best = at
                break
            at = best
        keep = self._siblings(best, worth, blocks) if tag[best] not in ("article", "main") else {best}
        taken = [False] * n
        for k in range(n):
            taken[k] = k in keep or k > 0 and taken[parent[k]]
        return " ".join(text for node, text, _, _ in blocks if taken[node])

    def _siblings(self, best: int, worth: list[float], blocks: list) -> set[int]:
        """The best container and those of its siblings that score like it, read like sentences, or are headings right before."""
        if not best:
            return {0}
        tag, parent, above = self.tag, self.parent, self.parent[best]
        least = max(1.0, worth[best] * SIBLING)
        texts: dict[int, list] = {}
        order = []
        for node, text, inside, _ in blocks:
            k = node
            while k > above and parent[k] != above:
                k = parent[k]
            if k > above and parent[k] == above:
                if k not in texts:
                    texts[k] = []
                    order.append(k)
                texts[k].append((text, inside))
        keep = {best}
        for k in order:
            if worth[k] >= least and tag[k] != "p":
                keep.add(k)
            elif tag[k] in ("p", "pre", "blockquote", "ul", "ol", "table"):
                length, inside = sum(len(t) for t, _ in texts[k]), sum(i for _, i in texts[k])
                if length > 80 and inside < 0.25 * length or not inside and re.search(r"[.!?…]['\"”»)]*$", texts[k][-1][0]):
                    keep.add(k)
        last = [k for k in order if tag[k] in HEADINGS]
        for k in last:
            later = [x for x in order if x > k and tag[x] not in HEADINGS]
            if later and later[0] in keep:
                keep.add(k)
        return keep


def main_text(html: str) -> str:
    """The article of a page, blocks in page order; empty if there is none."""
    return Page(html).main_text()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points); a row for each row.

    Null html is an empty page; a page without an article has an empty text and
    no characters.  Ids and urls may be null or repeat.  Broken markup is read
    as far as it goes: elements left open end with what holds them, a cut-off
    last tag is dropped.  An empty table gives no rows; other columns are not
    looked at.  Each page is read by itself, whole, a page at a time in memory;
    a scan of few tasks is dealt over the cluster first."""
    names, types = ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for page, url, html in zip(*b.columns, strict=True):
                h = html.as_py() or ""
                text = main_text(h)
                rows.append((page.as_py(), url.as_py(), text, len(text)))
                held += len(h)
                if held > STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    given = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
