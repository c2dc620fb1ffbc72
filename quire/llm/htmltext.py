"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element.  The lengths of the lines are summed over
windows of WINDOW lines.  The text begins where that sum surges from nothing and ends where it dives
to nothing again; of the stretches between, those whose sum reaches SURGE somewhere are kept whole.

What has a length: text outside links (a line's links count once they are LINK long together), and
twice that, links included, within article and main elements.  Menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are taken out with the markup and leave blank lines:
enough for a dive where they stand between other things, a single one within an article or main
element, which they only interrupt.  So do the edges of outermost article and main elements, whose
text is judged apart from what stands beside it.

Edge cases: null or empty html gives the empty text; pages without any surge keep every stretch;
unclosed and misnested tags, comments and quotes are tolerated, in time linear in the page; repeated
rows are treated alike; pages of any length are read whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import batch_of, per_batch

WINDOW = 3
SURGE = 80
LINK = 120
ARTICLE = 2

#: A tag; quotes count after an equals sign only, and what has been read is never read again.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]+|=\s*+(?:"[^"]*"|'[^']*')|=)*+))>""")
#: The same without regard to quotes, for pages whose quotes do not match.
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Contents are no text at all.
_OPAQUE = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "head", "title", "object", "canvas", "audio", "video", "math", "datalist", "xmp", "noframes"}
#: Text in these is not the page's own.
_ASIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button"}
_BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = ("article", "main")
#: A whole class or id: a place, what it is, and what it is made of; the first and last may lack.
_NOISE = re.compile(
    r"(?:(?:site|page|main|global|primary|secondary|top|bottom|left|right|post|entry|article|user|reader|cookie|gdpr|google|social|sub)[-_]?)?"
    r"(?:ads?|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|toolbar|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription"
    r"|signup|login|comments?|commentlist|disqus|respond|replies|pagination|pager|skip|copyright|legal)"
    r"(?:[-_](?:bar|box|block|area|section|container|wrap|wrapper|inner|list|item|items|links?|buttons?|slot|unit|form|thread|posts?|articles?|stories|notice|banner|message|consent|menu|nav|text|\d+))?"
)
#: Noise on a page, but not within an article, whose own head is part of it.
_HEAD = re.compile(r"(?:(?:site|page|main|global|top|post|entry|article)[-_]?)?(?:header|topbar|top)(?:[-_](?:bar|box|block|area|section|container|wrap|wrapper|inner))?")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
#: <p> ends an open <p>, and so on.
_REPEATED = ("p", "li", "dt", "dd", "tr", "td", "th", "option")


def _by_attributes(attrs: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element or give it the role of an aside; whether a class says so; whether one says that it is a head."""
    role = noise = head = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for word in value.split():
                noise = noise or _NOISE.fullmatch(word) is not None
                head = head or _HEAD.fullmatch(word) is not None
        elif key == "role":
            role = role or value in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "itemprop" and value == "comment":
            role = True
    return role, noise, head


def _parts(page: str) -> Iterator[str | tuple[str, bool, str]]:
    """Stretches of text and (name, closing, attributes) of tags; comments and opaque contents are left out."""
    at, last = 0, page.rfind(">")
    tag, endless = _TAG, set()  # opaque elements of which no further end exists
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin >= last:
            yield page[at:]
            return
        if begin > at:
            yield page[at:begin]
        mark = page[begin + 1 : begin + 2]
        if mark in ("!", "?"):
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                if end < 0:
                    return
                at = end + 3
            else:
                at = page.find(">", begin) + 1
            continue
        m = tag.match(page, begin)
        if not m and (mark.isalpha() or mark == "/") and tag is _TAG:
            if _BARE.match(page, begin):
                tag = _BARE  # an open quote runs to the end of the page
                at = begin
                continue
        if not m:
            yield "<"
            at = begin + 1
            continue
        at = m.end()
        name, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if name in _OPAQUE and not closing:
            if not attrs.endswith("/") and name not in endless:
                end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    if name not in ("head", "title"):
                        return
            continue
        yield name, closing, attrs


def _wrappers(parts: list) -> set[int]:
    """Places of the opening tags whose element holds a main element or a first-rank heading."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    inside: Counter[str] = Counter()
    marked = 0  # how many of the stack are known to be wrappers; they are its first ones
    for i, part in enumerate(parts):
        if isinstance(part, str):
            continue
        name, closing, attrs = part
        if name in _VOID:
            continue
        if closing:
            if inside[name]:
                while True:
                    top, _ = stack.pop()
                    inside[top] -= 1
                    if top == name:
                        break
                marked = min(marked, len(stack))
            continue
        if name in ("main", "h1"):
            out.update(at for _, at in stack[marked:])
            marked = len(stack)
        if not attrs.endswith("/") or name in _BLOCK:
            stack.append((name, i))
            inside[name] += 1
    return out


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, length) of each block in order; ("", 0) for blank lines."""
    parts = list(_parts(page))
    wrappers = _wrappers(parts)
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, noisy, article or main
    opened: Counter[str] = Counter()
    noisy = articles = 0

    def clean(pieces: list[str]) -> str:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        return text

    def flush() -> None:
        text, link = clean(buffer), len(clean(linked))
        if text and not noisy:
            out.append((text, ARTICLE * len(text) if articles else max(0, len(text) - link) if link < LINK else len(text)))

    def blank(count: int) -> None:
        flush()
        out.extend([("", 0)] * count)

    def push(name: str, is_noisy: bool) -> None:
        nonlocal noisy, articles
        is_main = name in _MAIN
        if is_noisy and not noisy:
            blank(1 if articles else WINDOW)
        elif is_main and not articles and not noisy:
            blank(WINDOW)
        stack.append((name, is_noisy, is_main))
        opened[name] += 1
        noisy += is_noisy
        articles += is_main

    def pop() -> str:
        nonlocal noisy, articles
        name, was_noisy, was_main = stack[-1]
        if was_noisy and noisy == 1:
            flush()
        elif was_main and articles == 1 and not noisy:
            blank(WINDOW)
        stack.pop()
        opened[name] -= 1
        noisy -= was_noisy
        articles -= was_main
        return name

    for i, part in enumerate(parts):
        if isinstance(part, str):
            buffer.append(part)
            if opened["a"]:
                linked.append(part)
            continue
        name, closing, attrs = part
        if name in _BLOCK:
            flush()
        elif name in ("td", "th"):
            buffer.append(" ")
        if name in _VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if attrs.endswith("/") and name not in _BLOCK:
            continue
        if stack and stack[-1][0] == name and (name in _REPEATED or name == "a"):
            pop()
        is_noisy = name in _ASIDE and not (name == "header" and articles)
        if not is_noisy and attrs and name not in ("html", "body", *_MAIN):
            role, noise, head = _by_attributes(attrs)
            is_noisy = role or (noise or head and not articles) and i not in wrappers
        push(name, is_noisy)
    flush()
    return out


def stretches(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, behind last) line of each kept stretch, from where the window sum surges up to where it dives."""
    total = sum(sizes[: window - 1])
    found: list[tuple[int, int, int]] = []  # first, behind last, highest sum
    begin, peak = -1, 0
    for i, size in enumerate(sizes):
        total += sizes[i + window - 1] if i + window - 1 < len(sizes) else 0
        if total:
            if begin < 0 and size:
                begin = i
            peak = max(peak, total)
        elif begin >= 0:
            found.append((begin, i, peak))
            begin, peak = -1, 0
        total -= size
    if begin >= 0:
        found.append((begin, len(sizes), peak))
    some = [s for s in found if s[2] >= surge]
    return [(a, b) for a, b, _ in some or found]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    return "\n".join(text for a, b in stretches([size for _, size in lines]) for text, _ in lines[a:b] if text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def make():
        def each(b):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            return batch_of([(id_col, b.schema.field(0).type), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())], [b.column(0), b.column(1), texts, [len(t) for t in texts]])

        return each

    return src.mapInArrow(per_batch(make), f"`{id_col}` {src.schema['id'].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint")
