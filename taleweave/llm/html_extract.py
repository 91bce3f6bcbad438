"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its word count, its link density (the
share of its words inside links), the same two figures of the block before and the block after, whether it is a
heading, and three signs of the markup around it: ``away``, that it stands in a part of a page that is not the article
(``nav``, ``footer``, ``form`` and the like by tag or ARIA role, and comments), ``named``, that a class or id calls
a part around it a sidebar, notice, advert or the like, and ``here``, that it stands in the article. A part that holds
the page's main element is neither ``away`` nor ``named``, nor is a form around paragraphs, and names such as
``no-sidebar`` or ``has-comments`` say nothing of what they stand on. Within the article a name decides nothing by
itself: long paragraphs under "social-history" are text, a line or a list of links under it is not.
A decision tree, grown here by Gini impurity on the blocks of a small table of labelled pages, keeps or drops each
block. ``labelled_pages`` is that table: layouts of news, blog, forum and shop pages, in which each block is labelled.

Scripts, styles, comments of the markup, the head and hidden parts never make blocks. Null or empty html
gives an empty text; a page cut off in the middle of a tag or an entity gives what was read by then.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Comments, declarations and tags. A quoted value may hold ``>``; with ``<`` in it, what follows it must go on like a
#: tag. A tag whose quote is never closed ends at its first ``>``, or with the page if no other tag follows.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^=>]|=\s*(?:"[^"<]*"|'[^'<]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s"'>][^\s>]*|(?=>|\Z)))*+)"""
    r"""(?:>|\Z|[^>]*>(?=[^<]*<)|.*)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")

#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"head", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element, up to the nearest of the walls.
P_ENDERS = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "option", "optgroup"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"ul", "ol", "dl", "table", "menu", "select", "article", "section", "div", "main", "aside", "body", "nav", "footer", "header", "form", "blockquote"}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
AWAY_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
AWAY_NAMES = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisements?|adsense|adslot|banners?|sponsor(?:ed|s)?|promos?|promotions?|nav|navs|navbar|navigation|menus?|breadcrumbs?|crumbs|pagination|pager|"
    r"sidebars?|aside|footers?|foot|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|signin|"
    r"share|sharing|social|related|recommended|recommendations|widgets?|toolbar|masthead|topbar|skip|copyright|paywall)(?=$|[-_])",
    re.I,
)
#: Names that say of an element what stands beside or inside it, not what it is.
SAID = re.compile(r"(?:^|[-_])(?:no|non|not|without|with|has|have|is|l|layout|hide|hides|side-by-side|without)(?=[-_])", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HERE_TAGS = {"article", "main"}
HERE_NAMES = re.compile(r"(?:^|[-_])(?:article|content|post|entry|story|body|main|text|prose)(?=$|[-_])", re.I)
HEADERS = re.compile(r"(?:^|[-_])(?:headers?|head)(?=$|[-_])", re.I)
COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|commentlist|replies|reply|responses|disqus|discussion|respond)(?=$|[-_])", re.I)


@dataclass
class Open:
    """An element, with what its start tag says of it and what it was found to hold."""

    tag: str
    outer: Open | None
    link: bool
    dropped: bool
    here: bool
    comment: bool
    named: bool
    part: bool
    form: bool
    header: bool
    is_main: bool
    heading: bool
    paragraphs: int = 0
    main: bool = False
    verdict: tuple[bool, bool] | None = None

    def closed(self) -> None:
        """Tells the element around it what it held."""
        if self.outer:
            self.outer.paragraphs += self.paragraphs + (self.tag == "p")
            self.outer.main = self.outer.main or self.main or self.is_main

    def aside(self) -> tuple[bool, bool]:
        """Whether this element or one around it is away, and whether one is named so; asked once the page is read, as it depends on what they hold."""
        unknown: list[Open] = []
        o: Open | None = self
        while o and o.verdict is None:
            unknown.append(o)
            o = o.outer
        away, named = (o and o.verdict) or (False, False)
        for o in reversed(unknown):
            holds = o.main or (o.form and o.paragraphs > 2)
            # a header within the article holds its headings; any other is the page's
            outside = o.header and not (o.outer and o.outer.here)
            away = away or o.comment or ((o.form or o.part or outside) and not holds)
            named = named or (o.named and not holds)
            o.verdict = away, named
        return away, named


@dataclass
class Block:
    text: str
    words: int
    linked: int
    at: Open | None
    heading: bool

    @property
    def aside(self) -> tuple[bool, bool]:
        return self.at.aside() if self.at else (False, False)

    @property
    def here(self) -> bool:
        return bool(self.at and self.at.here)


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) if v else "" for k, v in ATTRIBUTE.findall(source)}


def opened(tag: str, source: str, outer: Open | None) -> Open:
    a = attributes(source) if source.strip(" /\n\t") else {}
    whole = tag not in ("body", "html")
    names = [n for n in CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}").split() if not SAID.search(n)] if a and whole else []
    said = lambda pattern: any(pattern.search(n) for n in names)
    role, style = a.get("role", "").lower(), SPACE.sub("", a.get("style", "").lower())
    outer_here = bool(outer and outer.here)
    comment = said(COMMENTS) or (tag == "article" and outer_here and "comment" in (a.get("itemprop", "") + a.get("itemtype", "")).lower())
    part = tag in AWAY_TAGS - {"form"} or role in AWAY_ROLES - {"form"}
    named, form, header = said(AWAY_NAMES), tag == "form" or role == "form", tag == "header" or (said(HEADERS) and tag in BLOCK)
    away = part or named or form or comment or (header and not outer_here)
    main = tag == "main" or role == "main"
    here = tag in HERE_TAGS or role in ("main", "article") or (tag in BLOCK and said(HERE_NAMES) and not away)
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return Open(
        tag, outer, bool(outer and outer.link) or tag == "a", bool(outer and outer.dropped) or tag in DROPPED or hidden, outer_here or here, comment, named and not main and tag != "article", part, form, header, main,
        bool(outer and outer.heading) or tag in HEADINGS,
    )


def blocks(source: str | None) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    source = source or ""
    found: list[Block] = []
    stack: list[Open] = []
    standing: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    at = 0

    def end_block() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, link in parts if link)
            found.append(Block(text, len(text.split()), linked, stack[-1] if stack else None, bool(stack and stack[-1].heading)))
        parts.clear()

    def say(text: str) -> None:
        if text and not (stack and stack[-1].dropped):
            parts.append((entities.unescape(text) if "&" in text else text, bool(stack and stack[-1].link)))

    def leave(k: int) -> None:
        """The elements from the ``k``-th on end."""
        for o in reversed(stack[k:]):
            o.closed()
            standing[o.tag] -= 1
        del stack[k:]

    def close(tags: set[str], walls: set[str]) -> None:
        if not any(standing[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                if any(o.tag in BLOCK for o in stack[k:]):
                    end_block()
                leave(k)
                return
            if stack[k].tag in walls:
                return

    for m in MARKUP.finditer(source):
        if m.start() < at:
            continue  # inside a raw element
        say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br" or tag == "p" and not standing["p"]:
                parts.append((" ", False))
            else:
                close({tag}, {"article", "body", "td", "th"} - {tag} if tag not in BLOCK else {"body"} - {tag})
            continue
        if tag in P_ENDERS:
            close({"p"}, WALLS)
        if tag in ENDED_BY:
            close(ENDED_BY[tag], WALLS)
        if tag in RAW:
            if tag == "textarea" or not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag == "br":
            parts.append(("\n", False))
            continue
        if tag in BLOCK:
            end_block()
        if tag not in VOID:
            stack.append(opened(tag, m[3] or "", stack[-1] if stack else None))
            standing[tag] += 1
    say(source[at:] if "<" not in source[at:] or not re.match(r"<[A-Za-z/!?]", source[at:]) else "")
    end_block()
    leave(0)
    return found


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "away", "named", "here", "heading")


def features(page: list[Block]) -> list[tuple[float, ...]]:
    density = [min(1.0, b.linked / b.words) for b in page]
    out = []
    for k, b in enumerate(page):
        before, after = k - 1, k + 1
        out.append(
            (
                float(b.words), density[k],
                float(page[before].words) if k else 0.0, density[before] if k else 0.0,
                float(page[after].words) if after < len(page) else 0.0, density[after] if after < len(page) else 0.0,
                *map(float, b.aside), float(b.here), float(b.heading),
            )
        )
    return out


#: Ends the text of the blocks of labelled pages that are main text.
MARK = "\u2020"


def labelled_pages(count: int = 240, seed: int = 1) -> list[str]:
    """Pages of usual layouts, in which the blocks of the main text end in ``MARK``; words are made of syllables, nothing comes from a corpus."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(("ka", "lo", "mi", "ru", "te", "sa", "no", "vi")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{r.randrange(999)}">{words(low, high)}</a>'

    def element(tag: str, names: tuple[str, ...], inside: str) -> str:
        name = r.choice(names)
        return f'<{tag} {r.choice(("class", "id"))}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return r.choice((f"<nav><ul>{items}</ul></nav>", element("div", ("menu", "main-nav", "breadcrumbs", "pagination"), f"<ul>{items}</ul>"), f"<ul>{items}</ul>"))

    def prose() -> str:
        kind = r.random()
        if kind < 0.1:
            return f"<ul>{''.join(f'<li>{words(2, 20)}{MARK}</li>' for _ in range(r.randint(2, 5)))}</ul>"
        if kind < 0.16:
            return f"<blockquote>{words(5, 60)}{MARK}</blockquote>"
        if kind < 0.22:
            return f"<h{r.choice((2, 3))}>{words(2, 8)}{MARK}</h{r.choice((2, 3))}>"
        if kind < 0.27:
            return f"<p>{words(0, 4)} {link(2, 9)}{MARK}</p>"
        if kind < 0.29:
            return f"<h3>{link(2, 8)}{MARK}</h3>"
        linked = f"{link(1, 4)} {words(0, 20)}" if r.random() < 0.2 else ""
        return f"<p>{words(1, 120)} {linked}{MARK}</p>"

    def aside() -> str:
        return r.choice(
            (
                lambda: f"<aside><h3>{words(1, 4)}</h3>{''.join(f'<p>{words(3, 40)}</p>' for _ in range(r.randint(1, 3)))}</aside>",
                lambda: element("div", ("ad", "advert", "banner-box", "sponsored", "promo"), words(3, 40)),
                lambda: element("div", ("sidebar", "related", "widget", "recommended"), f"<h4>{words(1, 4)}</h4><ul>{''.join(f'<li>{link(2, 9)}</li>' for _ in range(r.randint(2, 6)))}</ul>"),
                lambda: element("div", ("cookie-notice", "consent", "newsletter", "alert"), f"<p>{words(6, 40)} {link()}</p>"),
                lambda: f"<form><label>{words(1, 3)}</label><p>{words(2, 15)}</p></form>",
            )
        )()

    def section() -> str:
        """A part of the article under a name that could be that of a sidebar or notice."""
        long = "".join(f"<p>{words(45, 160)}{MARK}</p>" for _ in range(r.randint(1, 3)))
        return element("div", ("social-history", "related-work", "banner-story", "share-prices", "notice-period"), long)

    def comments() -> str:
        return element("div", ("comments", "responses", "comment-list"), "".join(f"<p>{words(3, 90)}</p>" for _ in range(r.randint(1, 5))))

    pages = []
    for _ in range(count):
        body = [f"<h1>{words(2, 12)}{MARK}</h1>", *(prose() for _ in range(r.randint(1, 12)))]
        if r.random() < 0.4:
            body.insert(r.randint(1, len(body)), aside())
        if r.random() < 0.3:
            body.insert(r.randint(1, len(body)), section())
        if r.random() < 0.3:
            body.append(comments())
        wrap = r.choice(
            (
                lambda x: f"<article>{x}</article>", lambda x: f'<article class="post has-comments">{x}</article>', lambda x: f"<main>{x}</main>", lambda x: element("div", ("content", "post-body", "no-sidebar", ""), x),
                lambda x: f'<div class="row with-sidebar"><article>{x}</article></div>', lambda x: x,
            )
        )
        page = [menu() if r.random() < 0.9 else "", f"<header><p>{words(1, 9)}</p></header>" if r.random() < 0.4 else "", aside() if r.random() < 0.6 else "", wrap("".join(body))]
        # boilerplate that no name gives away: short lines beside lists of links
        plain = lambda: f"<div>{words(1, 7)}</div><div>{''.join(f'<p>{link(1, 5)}</p>' for _ in range(r.randint(2, 6)))}</div>"
        page[1:1] = [plain()] if r.random() < 0.3 else []
        page += [comments() if r.random() < 0.4 else "", plain() if r.random() < 0.4 else "", aside() if r.random() < 0.5 else "", f"<footer>{words(2, 25)} {link() if r.random() < 0.5 else ''}</footer>" if r.random() < 0.9 else ""]
        whole = "".join(page)
        pages.append(f"<html><head><title>{words(1, 6)}</title></head><body>{f'<form id=page>{whole}</form>' if r.random() < 0.1 else whole}</body></html>")
    return pages


def labelled_blocks(pages: list[str]) -> tuple[list[tuple[float, ...]], list[bool]]:
    """Features and labels of all blocks of labelled pages."""
    rows, labels = [], []
    for page in map(blocks, pages):
        labels += [MARK in b.text for b in page]
        for b in page:
            b.text = b.text.replace(MARK, "")
            b.words = max(1, len(b.text.split()))
        rows += features(page)
    return rows, labels


@dataclass
class Node:
    feature: int
    cut: float
    low: Node | bool
    high: Node | bool


def grow(rows: list[tuple[float, ...]], labels: list[bool], depth: int, least: int) -> Node | bool:
    """A binary tree by Gini impurity; ties go to the first feature and the lowest cut."""
    keep = sum(labels)
    if depth == 0 or keep in (0, len(labels)) or len(labels) < 2 * least:
        return 2 * keep >= len(labels)

    def impurity(n: int, k: int) -> float:
        return 2 * k * (n - k) / n

    best: tuple[float, int, float] | None = None
    for j in range(len(rows[0])):
        values = sorted({r[j] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low = [x for r, x in zip(rows, labels, strict=True) if r[j] <= cut]
            n, k = len(low), sum(low)
            if min(n, len(labels) - n) < least:
                continue
            loss = impurity(n, k) + impurity(len(labels) - n, keep - k)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, j, cut)
    if best is None or best[0] >= impurity(len(labels), keep) - 1e-12:
        return 2 * keep >= len(labels)
    _, j, cut = best
    side = [r[j] <= cut for r in rows]
    low, high = ([(r, x) for r, x, s in zip(rows, labels, side, strict=True) if s == want] for want in (True, False))
    return Node(j, cut, grow([r for r, _ in low], [x for _, x in low], depth - 1, least), grow([r for r, _ in high], [x for _, x in high], depth - 1, least))


@lru_cache(maxsize=4)
def tree(depth: int = 8, least: int = 8, pages: tuple[str, ...] | None = None) -> Node | bool:
    """The tree of the labelled ``pages``, by default of the module's own."""
    return grow(*labelled_blocks(list(pages) if pages is not None else labelled_pages()), depth, least)


def keeps(node: Node | bool, row: tuple[float, ...]) -> bool:
    while isinstance(node, Node):
        node = node.low if row[node.feature] <= node.cut else node.high
    return node


def main_text(source: str | None, model: Node | bool | None = None) -> str:
    """The blocks of a page that the ``model`` keeps (by default the module's own), two line feeds between them."""
    page = blocks(source)
    model = tree() if model is None else model
    return "\n\n".join(b.text for b, row in zip(page, features(page), strict=True) if keeps(model, row))


def extract_main_text(docs: DataFrame, *, html: str = "html", keys: tuple[str, ...] = ("page_id", "url"), pages: tuple[str, ...] | None = None) -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` of every page, in one narrow pass. ``pages`` are labelled pages to learn from, their main text marked by ``MARK``."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    model = tree(pages=pages)  # a few nodes, grown once and sent with the tasks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(x, model) if isinstance(x, str) else "" for x in frame.iloc[:, -1]]
            yield frame.iloc[:, :-1].assign(text=text, n_chars=[len(t) for t in text])

    return docs.select(*keys, F.col(html).cast("string").alias("__html")).mapInPandas(run, schema)
