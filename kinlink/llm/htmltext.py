"""Blocks of visible text of an HTML page, with what the markup says of each.

One pass over the tags, without a tree: a stack of open elements tells where text stands. Broken markup
is read as browsers do where it matters: unknown end tags are ignored, an end tag closes what is open
inside, a paragraph ends where the next block begins, raw-text elements end at their own end tag only,
and an unfinished tag at the end of a page is dropped.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<other>[!?/]))")
_LOOSE = re.compile(r"[^>]*+>")
_ATTR = re.compile(r"([A-Za-z_:][^\s=/>\"']*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TOKEN = re.compile(r"[a-z0-9]+")

#: Elements by their role (fixed values).
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option datalist xmp noembed noframes button".split())
APART = frozenset("nav footer aside menu dialog".split())
#: A form that one of these begins in is a wrapper of the page, as some servers write it (fixed values).
PAGE_PARTS = frozenset("article main header footer nav h1".split())
#: Elements that hold text rather than a part of a page; their ids are anchors (fixed values).
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption pre blockquote figcaption span a b i em strong small code".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that set a part of a page apart (fixed values).
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments "
    "disqus reply replies respond related recommended recommendations contentinfo complementary".split()
)
#: Words that sites put on their own parts and authors on parts of an article: what they mark is doubtful (fixed values).
DOUBTFUL = frozenset("search widget social share sharing login signup subscribe subscription pagination pager".split())
#: Those of MARKS that also hold when an article begins inside (fixed values): others may be on a wrapper of the whole page.
FIRM = frozenset("comment comments disqus reply replies respond related recommended recommendations sponsor sponsored ad ads advert advertisement promo".split())
#: Those of FIRM that hold on an article element itself, as comments are often written as such (fixed values).
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Beginnings of class names that tell what a text is about or what a page has (fixed values).
ABOUT = ("tag-", "category-", "topic-", "has-", "no-", "with-", "without-", "is-", "single-")


@dataclass(frozen=True)
class Block:
    """text; main: inside an article or main element; apart: inside a part that isn't the article's; doubtful: the markup leaves that open."""

    text: str
    main: bool
    apart: bool
    doubtful: bool


_NO, _DOUBT, _SOFT, _FIRM = range(4)


def _apart(name: str, attrs: str, inside: bool) -> int:
    """_FIRM: apart in any case; _SOFT: apart unless an article begins inside; _DOUBT: doubtful; _NO: none of these."""
    if name in APART:
        return _FIRM
    if name == "header" and not inside:
        return _SOFT
    if not attrs or attrs.isspace() or name in ("body", "html"):
        return _NO
    whole = name in ("article", "main")
    found = _NO
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return _FIRM
        if key in ("class", "role") or key == "id" and name not in TEXTUAL and not whole:
            words = {w for part in value.split() if not part.startswith(ABOUT) for w in _TOKEN.findall(part)}
            if not (COMMENTS if whole and not inside else FIRM).isdisjoint(words):
                return _FIRM
            if not whole and not MARKS.isdisjoint(words):
                found = _SOFT
            elif not whole and not DOUBTFUL.isdisjoint(words):
                found = max(found, _DOUBT)
    return found


def blocks(page: str | None) -> list[Block]:
    """Blocks of page in order; those without text are left out. None has none."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # name, and whether it hides, how it is set apart, whether it is main
    hides = firm = soft = doubt = mains = base = 0  # base: what was softly apart where the article began
    forms, n_forms, wrappers = [], 0, set()  # open forms; those that hold parts of the page
    in_form: list[int] = []  # the form of each block, 0 for none
    held: list[str] = []
    breaks = at = 0
    lower = None

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(text, mains > 0, firm > 0 or soft > base, doubt > 0))
                in_form.append(forms[-1] if forms else 0)

    def pop(to: int) -> None:
        nonlocal hides, firm, soft, doubt, mains, base
        for name, h, a, m in stack[to:]:
            hides, firm, soft, doubt, mains = hides - h, firm - (a == _FIRM), soft - (a == _SOFT), doubt - (a == _DOUBT), mains - m
            if name == "form":
                forms.pop()
        del stack[to:]
        base = base if mains else 0

    while True:
        start = page.find("<", at)
        if start < 0:
            if not hides:
                held.append(page[at:])
            break
        if start > at and not hides:
            held.append(page[at:start])
            if breaks and not page[at:start].isspace():
                breaks = 0
        m = _TAG.match(page, start)
        if m is None:
            nxt = page[start + 1 : start + 2]
            loose = _LOOSE.match(page, start + 1) if nxt == "/" or nxt.isascii() and nxt.isalpha() else None
            if loose is None and (nxt == "/" or nxt.isascii() and nxt.isalpha()):
                break  # an unfinished tag
            if loose is None:
                if not hides:
                    held.append("&lt;")
                at = start + 1
            else:
                at = loose.end()
            continue
        if m["comment"] is not None:
            end = page.find("-->", start + 4) if page[start + 4 : start + 5] != ">" else start + 2
            at = len(page) if end < 0 else end + 3
            continue
        if m["other"]:
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        at, name = m.end(), m["name"].lower()
        if m["end"]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    if name in BLOCK or any(s[0] in BLOCK for s in stack[n:]):
                        flush()
                    pop(n)
                    break
            else:
                if name == "p" or name in BLOCK and not hides:
                    flush()
            continue
        if name == "br":
            breaks += 1
            held.append(" ")
            if breaks > 1:
                flush()
            continue
        if name in BLOCK:
            flush()
            breaks = 0
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            elif name != "p" and name not in ("li", "td", "th", "tr", "dd", "dt"):
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == "p":
                        pop(n)
                        break
                    if stack[n][0] in BLOCK:
                        break
            elif name in ("p", "li", "tr", "td", "th", "dd", "dt"):
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == name or name in ("td", "th") and stack[n][0] in ("td", "th") or name in ("dd", "dt") and stack[n][0] in ("dd", "dt"):
                        pop(n)
                        break
                    if stack[n][0] in BLOCK and stack[n][0] != "p":
                        break
        if name in VOID:
            continue
        if name in RAW:
            if lower is None:
                lower = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        if m["attrs"].endswith("/") and name in ("svg", "math"):
            continue
        hide, apart, main = int(name in HIDDEN), _apart(name, m["attrs"], mains > 0), int(name in ("article", "main"))
        stack.append((name, hide, apart, main))
        base = soft if main and not mains else base
        hides, firm, soft, doubt, mains = hides + hide, firm + (apart == _FIRM), soft + (apart == _SOFT), doubt + (apart == _DOUBT), mains + main
        if name in PAGE_PARTS:
            wrappers.update(forms)
        if name == "form":
            n_forms += 1
            forms.append(n_forms)
        if name == "body" and hides:  # a head that was never closed
            for n, s in enumerate(stack[:-1]):
                if s[0] == "head":
                    stack[n] = ("head", 0, s[2], s[3])
                    hides -= 1
                    break
    flush()
    return [Block(b.text, b.main, b.apart or f > 0 and f not in wrappers, b.doubtful) for b, f in zip(out, in_form, strict=True)]
