"""HTML as containers and blocks of text: what the template operator compares between the pages of a host."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

#: Comments, declarations, tags (with whole quoted values if they end), a stray angle, text.
PIECE = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<|[^<]++""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements of HTML by what they do to text.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STRUCTURE = frozenset("html body div section article main nav header footer aside form ul ol dl table blockquote details dialog menu fieldset figure center".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th caption figcaption address summary legend tbody thead tfoot head".split())
BREAKS = frozenset("br hr option".split())
#: Elements that are never part of the main text, the header of a page too (not that of an article).
APART = frozenset("nav footer aside form menu dialog select button svg template object video audio canvas head".split())
#: Words in class, id or role that say the same of an element.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
    popup modal overlay newsletter subscribe signup login sidebar sidebars widget widgets related recommended recommendations share sharing social
    menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar topbar comment comments disqus reply
    replies respond complementary contentinfo search alertdialog alert dialog menubar commentlist commentform adsbygoogle cookiebar cookiebanner
    topnav subnav sitenav""".split()
)
#: Those of them that count on article and main too.
REMARKS = frozenset("comment comments commentlist reply replies ad ads advert advertisement adsbygoogle sponsored".split())
#: Elements that an opening tag ends if they are open, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset(("h1", "h2"))


@dataclass(slots=True)
class Block:
    """Text between two borders of blocks. chain: the containers around it, from the page inwards; mark: how many containers had
    begun; leaf: it stands in a paragraph, cell or the like; apart: 2 inside an element that is no main text, 1 if only a name or a form says so."""

    text: str
    chain: tuple[int, ...]
    mark: int
    leaf: bool
    heading: bool
    apart: int
    linked: int


@dataclass(slots=True)
class Page:
    """marks: the containers in the order in which they begin; kinds: 2 of an article, 1 of a main element outside one, else 0."""

    marks: list[int] = field(default_factory=lambda: [0])
    blocks: list[Block] = field(default_factory=list)
    kinds: dict[int, int] = field(default_factory=lambda: {0: 0})


@dataclass(slots=True)
class Open:
    tag: str
    token: int
    apart: bool
    soft: bool
    wraps: bool
    kind: int
    structure: bool


def described(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(signature, hinted, hidden) of an element: tag with class, id and role less their digits; hinted is 2 for remarks and adverts."""
    words: set[str] = set()
    names, hidden = [], False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            names.append(f"{name}={' '.join(sorted(re.sub('[0-9]+', '', value).split()))}")
            for part in value.split():
                found = [w.lower() for w in WORD.findall(part)]
                words.update(w for k, w in enumerate(found) if not k or found[k - 1] not in ("has", "with", "no", "without"))
                if tag == "div" and found and found[-1] == "header" and found[0] in ("header", "site", "page", "top", "global"):
                    words.add("masthead")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return f"{tag} {' '.join(sorted(names))}", 2 if words & REMARKS else int(bool(words & HINTS) and tag not in ("article", "main")), hidden


KNOWN: dict[tuple[str, str], tuple[str, int, bool]] = {}


def described_once(tag: str, attributes: str) -> tuple[str, int, bool]:
    found = KNOWN.get((tag, attributes))
    if found is None:
        if len(KNOWN) > 20_000 or len(attributes) > 1000:
            KNOWN.clear()
        found = KNOWN[tag, attributes] = described(tag, attributes)
    return found


def spaced(text: str) -> str:
    return " ".join(html.unescape(text).split())


def parsed(source: str) -> Page:
    """The containers and blocks of a page, whatever is missing or wrong in it.

    Paragraphs and cells end where the next one begins; an end tag ends all that is open inside its element, one without an
    element nothing; comments, scripts and the like vanish; a tag that the page's end cuts off is dropped.
    """
    page, stack, parts = Page(), [Open("", 0, False, False, False, 0, True)], []
    linked, in_link, at, n = 0, False, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = spaced("".join(parts))
            if text:
                leaf = next((o for o in reversed(stack) if not o.structure), None)
                chain = tuple(o.token for o in stack if o.structure)
                inner = not stack[-1].structure
                apart = max(2 - o.soft if o.apart else 0 for o in stack)
                page.blocks.append(Block(text, chain, len(page.marks), inner, leaf is not None and inner and leaf.tag in HEADINGS, apart, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(least: int) -> None:
        del stack[least:]

    while at < n:
        m = PIECE.match(source, at)
        at = m.end()
        close_mark, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                parts.append(m[0])
                if in_link:
                    linked += len(m[0])
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close_mark:
                end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = end.start() if end else n
            continue
        block = tag in STRUCTURE or tag in LEAVES
        if close_mark:
            if tag == "a":
                in_link = False
            if block:
                flush()
                in_link = False
            least = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
            if least is not None and (block or not any(o.structure or o.tag in LEAVES for o in stack[least + 1 :])):
                if not block:
                    flush()
                close(least)
            continue
        if tag in BREAKS:
            flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link = True
        signature, hinted, hidden = described_once(tag, attributes) if attributes or block else (tag, 0, False)
        if block:
            flush()
            in_link = False
            while len(stack) > 1 and not stack[-1].structure and (stack[-1].tag not in LEAVES or stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                stack.pop()  # text-level elements and paragraphs end at the next block
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].structure:
                    break
                if stack[k].tag in ENDS.get(tag, ()) or stack[k].tag == "head":
                    close(k)
        outer = stack[-1]
        kind = max(outer.kind, 2 if tag == "article" else 1 if tag == "main" or "role=main" in signature else 0)
        hard = hidden or tag in APART and tag != "form" or tag == "header" and outer.kind < 2
        apart = hard or tag == "form" or hinted > 0 and tag not in ("html", "body")
        soft = apart and not hard
        if kind > outer.kind and not apart:
            for o in stack:  # a wrapper that holds the article is no advert, whatever its name
                o.apart = o.apart and not o.wraps
        if block:
            structure = tag in STRUCTURE
            token = outer.token
            if structure:
                token = xxhash.xxh64_intdigest(f"{outer.token}/{signature}") >> 1
                page.marks.append(token)
                page.kinds[token] = kind if kind > outer.kind and not apart else 0
            stack.append(Open(tag, token, apart, soft, soft and hinted < 2, kind, structure))
        elif apart:
            flush()
            stack.append(Open(tag, outer.token, True, soft, False, kind, False))
    flush()
    return page
