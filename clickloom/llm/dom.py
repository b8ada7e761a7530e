"""A small tolerant HTML reader: the text blocks of a page and the elements they lie in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names and the usual words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head caption td th tr tbody thead tfoot option legend".split())
SELF_CLOSING = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"),
    "tfoot": ("td", "th", "tr", "tbody"),
}
SCOPE = frozenset("article aside body div dl html main nav ol section table td th ul footer header form".split())
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript "
    "object search select svg template textarea video".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "sidebar sidebars rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead "
    "footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments disqus "
    "respond replies reply pagination pager toolbar skip search form copyright disclaimer contentinfo complementary".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
DEPTH = 24  # deeper elements share the path of their ancestor at this depth


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    depth: int
    parent: Element | None
    hard: bool  # noise whatever it holds
    main: bool
    soft: bool  # noise by its names, unless it holds the main part
    chars: int = 0
    holds_main: bool = False
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    element: Element


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _open(tag: str, raw: str, parent: Element | None) -> Element:
    attrs = _attributes(raw)
    names = " ".join(attrs.get(a, "") for a in ("class", "id", "role")).lower()
    words = set(_WORD.findall(names))
    depth = parent.depth + 1 if parent else 0
    label = tag + "".join("." + w for w in sorted(words)[:4])
    if parent and depth > DEPTH:
        path = parent.path
    else:
        path = f"{parent.path}/{label}" if parent else label
    inside = bool(parent and parent.main)
    main = inside or tag in ("article", "main") or attrs.get("role", "").lower() == "main"
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    soft = tag not in ("html", "body", "main") and bool(words & NOISE_WORDS)
    soft |= tag == "header"
    element = Element(tag, path, depth, parent, hidden or tag in NOISE_TAGS, main, soft)
    if parent:
        parent.children.append(label)
    return element


def parse(html: str) -> tuple[list[Block], list[Element]]:
    """Blocks with text in page order, and all elements."""
    root = Element("#", "#", 0, None, False, False, False)
    stack, elements, blocks, run = [root], [], [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            holder = stack[-1]
            while holder.tag not in BLOCK and holder.parent:
                holder = holder.parent
            blocks.append(Block(text, holder))

    def close(names: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                del stack[k:]
                return
            if stack[k].tag in SCOPE:
                return

    at, lower = 0, None
    while at < len(html):
        found = _TOKEN.search(html, at)
        run.append(unescape(html[at : found.start()] if found else html[at:]))
        if not found:
            break
        at = found.end()
        if found[0].startswith("<![CDATA["):
            run.append(found[0][9:].removesuffix("]]>"))
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(e.tag in BLOCK for e in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in BLOCK:
            if tag in CLOSES_P:
                close(("p",))
            close(SELF_CLOSING.get(tag, ()))
            flush()
        if tag == "br":
            run.append(" ")
        raw = found[3] or found[6] or ""
        if tag in VOID:
            continue
        element = _open(tag, raw, stack[-1] if stack[-1] is not root else None)
        element.parent = stack[-1]
        elements.append(element)
        if tag in RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            skip = html.find(">", at)
            at = len(html) if skip < 0 else skip + 1
            continue
        if not raw.rstrip().endswith("/") or tag in BLOCK:
            stack.append(element)
    flush()
    return blocks, elements


def content_blocks(html: str) -> list[tuple[Block, bool]]:
    """Every block with whether page structure makes it part of the main text.

    Menus, footers and the like are out by element; elements named like noise are out unless they
    hold the article or most of the text. If a page marks its article (or main part), only that is in.
    """
    blocks, _ = parse(html)
    total = 0
    for block in blocks:
        chain, e = [], block.element
        while e:
            chain.append(e)
            e = e.parent
        if any(x.hard for x in chain):
            continue
        total += len(block.text)
        for x in chain:
            x.chars += len(block.text)
            x.holds_main |= block.element.main and not x.main
    kept, marked = [], False
    for block in blocks:
        e, fine, inside = block.element, True, False
        while e:
            inside |= e.main
            title = e.tag == "header" and e.main
            noisy = e.soft and not title and not e.holds_main and (e.main or 2 * e.chars <= total)
            if e.hard or noisy:
                fine = False
                break
            e = e.parent
        kept.append((block, fine, fine and inside))
        marked |= fine and inside
    return [(block, inside if marked else fine) for block, fine, inside in kept]
