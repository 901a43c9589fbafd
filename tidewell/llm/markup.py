"""Reading a page: its elements with their places in the tree, and its blocks of text.

One pass from left to right; the time is in proportion to the page, whatever its
markup.  A quote that is never closed does not swallow the page, and elements are
numbered instead of spelled out, so depth costs nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import xxhash

# Element names of HTML and what they are for.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math object canvas video audio select title button".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FRAME_TAGS = frozenset("head nav footer aside form menu dialog search fieldset".split())
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Whole class names and ids that usually mark frame; a prior only, see ``htmltext``.
_FRAME_NAMES = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs comment comments disqus respond replies footer header masthead related recommended recommendations share sharing social"
    " newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip".split()
)
#: Elements that can hold a whole main text.
_HOLDS = frozenset("html body div article main section form center dialog aside nav td tr tbody table fieldset header footer".split())
#: Elements that another of these ends.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_INSIDE_P = frozenset(("html", "head", "body"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
#: Numbers of so many digits in class names are ids.
_DIGITS = re.compile(r"\d{4,}")

NAMED, HIDDEN, HOLDS, STOPS, TITLE = 1, 2, 4, 8, 16


@lru_cache(1 << 16)
def place(parent: int, name: str) -> int:
    """The number of an element's place: its parent's place and its own name."""
    return xxhash.xxh3_64_intdigest(f"{parent}/{name}") >> 1 or 1


@lru_cache(1 << 12)
def _ending(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@lru_cache(1 << 14)
def _flags(tag: str, attrs: str, in_article: bool) -> tuple[int, str]:
    """What an element is by its tag and attributes, and its name with its class for the path."""
    out = (HOLDS * (tag in _HOLDS)) | (STOPS * (tag in ("article", "main"))) | (TITLE * (tag == "h1"))
    out |= NAMED * (tag in _FRAME_TAGS or (tag == "header" and not in_article))
    if not attrs or attrs.isspace():
        return out, tag
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)}
    label = found.get("class", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDES.search(found.get("style", "")):
        out |= HIDDEN
    if found.get("role", "").lower() in _FRAME_ROLES or _FRAME_NAMES & set(f"{label} {found.get('id', '')}".lower().split()):
        out |= NAMED
    # Long numbers in class names tell pages apart, short ones places.
    return out, f"{tag}.{' '.join(_DIGITS.sub('#', label).split())}" if label else tag


@dataclass
class Page:
    """Elements by number: parent, place, flags (hidden is inherited); and the visible blocks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [1])
    flags: list[int] = field(default_factory=lambda: [HOLDS])
    kind: list[str] = field(default_factory=lambda: [""])
    #: (element, text) in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


def read(page: str | None) -> Page:
    """Elements and blocks of a page; a null page has neither."""
    page = page or ""
    out = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, hidden, in an article or main element
    count: dict[str, int] = {}
    parts: list[str] = []
    owner = 0
    end = len(page)
    last = {'"': page.rfind('"'), "'": page.rfind("'")}
    last_gt = page.rfind(">")
    endless: set[str] = set()

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.blocks.append((owner, text))
            parts.clear()

    def say(piece: str, decode: bool = True) -> None:
        nonlocal owner
        _, element, hidden, _ = stack[-1]
        if hidden:
            return
        if not parts:
            if piece.isspace():
                return
            owner = element
        parts.append(html.unescape(piece) if decode and "&" in piece else piece)

    def pop() -> str:
        tag = stack.pop()[0]
        count[tag] -= 1
        return tag

    def tag_end(at: int) -> int:
        """The end of a tag, past quoted values; the first > if a quote is left open."""
        first = gt = page.find(">", at)
        while True:
            m = _QUOTED.search(page, at, gt)
            if m is None:
                return gt
            if m.end() > last[m[1]]:
                return gt
            at = page.find(m[1], m.end()) + 1
            if at > gt:
                if at > last_gt:
                    return first
                gt = page.find(">", at)

    at = 0
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        closes = mark == "/"
        if page.startswith("<!--", lt):
            to = page.find("-->", lt + 4)
            at = end if to < 0 else to + 3
            continue
        if page.startswith("<![CDATA[", lt):
            to = page.find("]]>", lt + 9)
            say(page[lt + 9 : to if to >= 0 else end], decode=False)
            at = end if to < 0 else to + 3
            continue
        m = _NAME.match(page, lt + 1 + closes) if lt < last_gt else None
        if m is None and (lt > last_gt or not mark or mark not in "!?/"):
            say("<")
            at = lt + 1
            continue
        to = tag_end(m.end() if m else lt + 1)
        at = to + 1
        if m is None:
            continue
        tag = m[0].lower()
        if closes:
            if tag in _BLOCK:
                flush()
                if count.get(tag):
                    while pop() != tag:
                        pass
            elif stack[-1][0] == tag:
                pop()
            continue
        attrs = page[m.end() : to]
        if tag in _RAW:
            if not attrs.endswith("/") and tag not in endless:
                over = _ending(tag).search(page, at)
                if over:
                    at = over.end()
                elif tag in ("script", "style", "title", "textarea"):
                    at = end
                else:
                    endless.add(tag)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and parts:
                parts.append(" ")
            continue
        in_article = stack[-1][3]
        if tag not in _BLOCK:
            # An inline element counts only if it hides its text.
            if len(attrs) > 5 and _flags(tag, attrs, in_article)[0] & HIDDEN and not attrs.endswith("/"):
                stack.append((tag, stack[-1][1], True, in_article))
                count[tag] = count.get(tag, 0) + 1
            continue
        flush()
        if tag not in _INSIDE_P and count.get("p"):
            while pop() != "p":
                pass
        if stack[-1][0] in _SIBLINGS.get(tag, ()):
            pop()
        _, above, hidden, in_article = stack[-1]
        flags, name = _flags(tag, attrs, in_article)
        out.parent.append(above)
        out.path.append(place(out.path[above], name))
        hidden = hidden or bool(flags & HIDDEN)
        out.flags.append(flags | HIDDEN * hidden)
        out.kind.append(tag)
        stack.append((tag, len(out.parent) - 1, hidden, in_article or bool(flags & STOPS)))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out
