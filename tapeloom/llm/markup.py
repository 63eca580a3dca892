"""Web pages as balanced token streams: block elements open and close, and what lies between is text."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

OPEN, CLOSE, TEXT = 1, -1, 0

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>"
    r"|<(?:[!?]|/(?![A-Za-z]))[^>]*>"
    r"|<[/A-Za-z!?][^>]*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)

# How HTML elements behave.
VOID = set("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
#: Content that is no markup; it ends at its own end tag only.
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
#: Controls and pictures inside a line, left out with all they hold.
SKIPPED = set("audio button canvas datalist label map object optgroup option select svg template video".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math nobr output q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
IGNORED = {"html", "head", "body"}
#: What an opening element closes first, and where the search for it ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption"}
#: Deeper elements still break blocks but are no levels of their own.
DEEPEST = 100


@lru_cache(maxsize=8192)
def key_of(tag: str, attributes: str) -> str:
    """A block's token: its tag, classes (or id) with digits made #, and its ARIA role or hiddenness.

    The class ``c`` gives ``div.c``, an id ``div#c``; roles follow an ``@``.
    """
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next(filter(None, values), "").strip().lower())
    names = sorted(set(re.sub(r"\d+", "0", found.get("class", "")).split()))
    key = tag + "".join(f".{x}" for x in names)
    if not names and found.get("id"):
        key += "#" + re.sub(r"\d+", "0", re.sub(r"\s+", "-", found["id"]))
    marks = [found[x] for x in ("role", "itemprop") if found.get(x)] + ["hidden"] * ("hidden" in found)
    return key + "".join("@" + re.sub(r"\s+", "-", m) for m in marks)


def tidy(pieces: list[str]) -> str:
    """Text of a block: references decoded, white space turned into one space."""
    return " ".join(entities.unescape("".join(pieces)).split())


def _closing(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I)


CLOSING = {name: _closing(name) for name in RAW | SKIPPED}


def _after(page: str, name: str, at: int) -> int | None:
    """Where the element opened before ``at`` has ended; None if it never does."""
    depth = 1
    for found in CLOSING[name].finditer(page, at):
        if found[1]:
            depth -= 1
        elif name not in RAW:
            depth += 1
        if not depth:
            return found.end()
    return None


def stream(page: str | None) -> list[tuple]:
    """Tokens (OPEN, key), (CLOSE, key) and (TEXT, text, characters inside links), always balanced.

    Elements left open end with their parent, with a following sibling that implies it, or with the
    page; end tags without a start are ignored. Inline elements belong to the text around them, a
    line break is white space. Scripts, styles, comments, titles and controls give no tokens. Null
    and empty pages give none at all; text without markup is one text.
    """
    page = page or ""
    tokens: list[tuple] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked, links = 0, False
    at, end = 0, len(page)
    search = TOKEN.search

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = tidy(pieces)
            if text:
                tokens.append((TEXT, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tokens.append((CLOSE, stack.pop()[1]))

    def close_open(tags: set[str], stop: set[str]) -> None:
        """Close up to the outermost of ``tags`` that is open below the nearest of ``stop``."""
        depth = None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                depth = k
            elif stack[k][0] in stop:
                break
        if depth is not None:
            close(depth)

    while at < end:
        found = search(page, at)
        start = found.start() if found else end
        if start > at:
            text = page[at:start]
            pieces.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag, ending = found[2].lower(), bool(found[1])
        if tag in INLINE:
            if tag == "a":
                links = not ending
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW and not ending:
            at = _after(page, tag, at) or end
            continue
        if tag in SKIPPED:
            if not ending:
                at = _after(page, tag, at) or at
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        links = False
        if tag in IGNORED or tag == "hr":
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPE and tag not in SCOPE and tag != "tr":
                    break
            continue
        close_open({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            close_open(*IMPLIED[tag])
        elif tag in ("article", "main"):
            close_open({"nav"}, SCOPE)  # menus never hold the article: this one was left open
        if len(stack) < DEEPEST:
            key = key_of(tag, found[3])
            stack.append((tag, key))
            tokens.append((OPEN, key))
    flush()
    close(0)
    return tokens
