"""Tolerant reading of HTML: the text blocks of a page with their paths and roles."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# fixed names of the markup language
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
ZONES = frozenset("nav header footer aside form button menu dialog fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of text rather than a part of the page.
PIECES = HEADINGS | frozenset("p li td th tr tbody thead dt dd pre blockquote figcaption caption address summary legend".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class or id that name what is not the article, and what is.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus widget widgets toolbar pagination pager copyright skip taboola outbrain topbar teaser teasers paywall search".split()
)
MAIN_NAMES = frozenset("article articlebody content maincontent post postbody posting entry story storybody main text body prose".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|/[^a-zA-Z][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Block(NamedTuple):
    text: str
    path: str
    other: bool  # inside a menu, footer, advert, form, comment ...
    main: int  # 3 inside an article, 2 inside main, 1 inside a container that is named so, 0 elsewhere
    links: int  # characters inside links
    ids: tuple[int, ...]  # numbers of the elements around it, in the order of the path's parts


class _Open(NamedTuple):
    name: str
    path: str
    other: bool
    main: int
    quiet: bool  # a header inside an article: its headings alone count
    number: int


def _attributes(attrs: str) -> tuple[str, set[str], bool]:
    """First class, lower-case words of class, id and role, and whether hidden."""
    first, words, hidden = "", set(), False
    if attrs:
        for name, a, b, c in _ATTRIBUTE.findall(attrs):
            value, name = a or b or c, name.lower()
            if name == "aria-hidden" or name == "hidden":
                hidden |= value.lower() in ("true", "hidden", "")
            elif name == "role":
                words.add(f"role={value.lower()}")
            else:
                if name == "class" and not first:
                    first = value.split()[0] if value.split() else ""
                words.update(x.lower() for x in _WORDS.findall(value))
                words.update(x.lower().replace("-", "").replace("_", "") for x in value.split())
    return first, words, hidden


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed, stray and cut-off tags are borne; character references are decoded."""
    out: list[Block] = []
    stack = [_Open("", "", False, 0, False, 0)]
    opened = 0
    held: list[str] = []
    link_depth, link_chars = 0, 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = stack[-1]
                quiet = any(x.quiet for x in stack) and top.name not in HEADINGS
                out.append(Block(text, top.path, top.other or quiet, top.main, min(link_chars, len(text)), tuple([x.number for x in stack[1:]])))
        link_chars = 0

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            run = html[at:lt]
            run = unescape(run) if "&" in run else run
            held.append(run)
            if link_depth:
                link_chars += len(run)
        if lt == end:
            break
        m = _TAG.match(html, lt)
        if not m:
            nxt = html[lt + 1 : lt + 2]
            if (nxt.isalpha() and nxt.isascii()) or nxt in ("/", "!"):
                break  # a tag cut off by the end of the page
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1) or m.group(4))
        if name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
            continue
        if name == "br" or name == "hr":
            flush()
            continue
        attrs = m.group(3) or m.group(6) or ""
        if not closing and name in RAW:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
            if name not in INLINE:
                flush()
            continue
        if name in INLINE or name in VOID:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            if name in ("article", "nav", "footer", "header", "aside", "main", "body"):
                link_depth = 0
            continue
        top = stack[-1]
        if top.name == "p" and len(stack) > 1:
            stack.pop()
        else:
            same = CLOSES_SAME.get(name)
            while same and len(stack) > 1 and stack[-1].name in same:
                stack.pop()
        top = stack[-1]
        first, words, hidden = _attributes(attrs)
        roles = {w[5:] for w in words if w.startswith("role=")}
        in_article = top.main == 3
        quiet = name == "header" and in_article
        other = top.other or hidden or bool(roles & OTHER_ROLES) or (name in ZONES and not quiet) or (name not in ("article", "main", "body", "html") and bool(words & OTHER_NAMES))
        main = 3 if name == "article" or "article" in roles else max(top.main, 2 if name == "main" or "main" in roles else 1 if words & MAIN_NAMES and name not in ("body", "html") else 0)
        opened += 1
        stack.append(_Open(name, f"{top.path}>{name}" + (f".{first.replace('>', '')}" if first else ""), other, main, quiet, opened))
    flush()
    return out
