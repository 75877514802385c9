"""Main text of web pages by two passes over blocks."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes

# Names of HTML elements and their usual roles.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "button", "label",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = {"head", "nav", "menu", "aside", "footer", "form", "fieldset", "select", "button", "dialog", "search", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class and id that hint at surroundings: such blocks must be long to count.
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing",
    "social", "related", "recommended", "recommendations", "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "footer", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
    "login", "search", "copyright", "disclaimer",
}
#: An element opened here closes an open one of the same set, up to the containers named.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "blockquote", "form", "aside", "nav", "footer", "header"}
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was be by are this at from or an not have has he she they but which you we his her their were a i "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im es als auch an werden aus er hat dass sie nach wird bei einer um am sind "
    "le la les de des du et est un une en que qui dans pour pas sur au par plus ce il elle ne se sont avec son sa ses aux ou mais "
    "el los las y que del se con por para una es su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay".split()
)
# End of fixed values.

_TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_REST = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
#: Pass one: shares of stop words, characters of short blocks and of hinted ones, share of links outside and inside a marked article.
STOP_LOW, STOP_HIGH, SHORT, HINTED, MAX_LINKS, MAX_LINKS_INSIDE = 0.10, 0.20, 70, 600, 0.33, 0.5


@dataclass
class Block:
    """A block's text and features: characters inside links, whether in a marked article, among surroundings by element
    or role, under a container whose class hints at them, or a heading."""

    text: str
    linked: int
    main: bool
    out: bool
    hint: bool
    heading: bool


def _surrounds(name: str, attributes: dict[str, str], main: bool) -> bool:
    """Whether the element stands for surroundings or is hidden, by the standard's own names."""
    if name in LEFT_OUT or (name == "header" and not main):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in ROLES


def _hints(name: str, attributes: dict[str, str]) -> bool:
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", label)
        if name in ("html", "body", "main", "article") and not parts[0].startswith("comment"):
            continue
        if not {"no", "has", "with", "without", "not"} & set(parts) and (parts[0] in HINTS or parts[-1] in HINTS):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in order, with the characters inside links and where they stand.

    Void, raw and unclosed elements are read as browsers do; white space inside a block is one space.
    """
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, inside a marked article, surroundings, hinted
    pieces: list[str] = []
    state = {"linked": 0, "link": 0, "breaks": 0}

    def flush() -> None:
        text = " ".join(htmllib.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            main, out, hint = stack[-1][1:] if stack else (False, False, False)
            heading = any(n in HEADINGS for n, *_ in stack[-2:])
            found.append(Block(text, state["linked"], main, out, hint, heading))
        state["linked"] = 0

    def write(raw: str) -> None:
        if raw:
            pieces.append(raw)
            if raw.strip():
                state["breaks"] = 0
                if state["link"]:
                    state["linked"] += len(" ".join(htmllib.unescape(raw).split()))

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if not tag:
            write(page[at:])
            break
        write(page[at : tag.start()])
        opening = tag.group(0)
        if opening == "<!--":
            stop = page.find("-->", tag.end())
            at = size if stop < 0 else stop + 3
            continue
        if opening == "<![CDATA[":
            stop = page.find("]]>", tag.end())
            at = size if stop < 0 else stop + 3
            continue
        if tag.group(1) is None:
            stop = page.find(">", tag.end())
            at = size if stop < 0 else stop + 1
            continue
        name, closing = tag.group(1).lower(), opening[1] == "/"
        rest = _REST.match(page, tag.end())
        stop = rest.end() if rest else page.find(">", tag.end()) + 1
        if not stop:
            break  # an unfinished tag at the end
        at = stop
        if name == "a":
            state["link"] = 0 if closing else 1
            continue
        if name in RAW and not closing:
            if page[stop - 2] != "/" or name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, stop)
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
            continue
        if name == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                flush()
            else:
                pieces.append(" ")
            continue
        if name not in BLOCK:
            continue
        flush()
        state["breaks"] = 0
        if closing:
            names = [n for n, *_ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
                if name not in ("p", "li"):
                    state["link"] = 0
            continue
        if name in VOID:
            continue
        shuts = CLOSES.get(name, {"p"} if name not in ("button", "label", "select", "option") else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shuts:
                del stack[k:]
                break
            if stack[k][0] in SCOPES:
                break
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTES.findall(page[tag.end() : stop - 1])} if stop - tag.end() > 1 else {}
        main, out, hint = stack[-1][1:] if stack else (False, False, False)
        out, hint = out or _surrounds(name, attributes, main), hint or _hints(name, attributes)
        main = main or name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        stack.append((name, main, out, hint))
    flush()
    return found


def stop_density(text: str) -> float:
    """The share of the words that are stop words."""
    words = [w.strip(".,;:!?()[]\"'«»„“”#*$%&").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def decide(block: Block) -> bool | None:
    """Pass one: True main text, False not, None undecided.

    Link density comes first, then length, then stop-word density. Inside a marked article links may be denser, and few stop
    words leave a block undecided instead of rejecting it; a hint asks for more length.
    """
    links = block.linked / len(block.text)
    if links > MAX_LINKS and not block.main:
        return False
    if block.out or (block.hint and len(block.text) < HINTED):
        return False
    if links > MAX_LINKS_INSIDE:
        return None
    if block.heading or len(block.text) < SHORT:
        return None if block.main or not links else False
    stops = stop_density(block.text)
    return True if stops >= STOP_HIGH else None if block.main or stops >= STOP_LOW else False


def labels(blocks: list[Block]) -> list[bool]:
    """Pass two: the undecided take the label of the nearest decided block, a heading that of the next.

    At equal distances both must be main text. If the page marks an article, neighbours are looked for on the same side of its
    border, inside or outside, and accepted blocks outside are as open as undecided ones, for the mark is evidence against
    them. Surroundings within an article count as outside. Without any decided neighbour a block
    is main text, but not outside a marked article or without a letter or digit.
    """
    inside = [b.main and not b.out and not b.hint for b in blocks]
    marked = any(inside)
    first = [decide(b) for b in blocks]
    if marked:
        first = [None if label and not i else label for i, label in zip(inside, first)]
    out = [False] * len(blocks)
    for side in (True, False):
        at = [k for k, i in enumerate(inside) if i == side]
        nearest: list[list] = [[None] * len(at), [None] * len(at)]
        for way, places in enumerate((range(len(at)), range(len(at) - 1, -1, -1))):
            last = None
            for j in places:
                last = j if first[at[j]] is not None else last
                nearest[way][j] = last
        for j, k in enumerate(at):
            if first[k] is not None:
                out[k] = first[k]
                continue
            before, after = nearest[0][j], nearest[1][j]
            if before is None and after is None:
                out[k] = side or (not marked and any(c.isalnum() for c in blocks[k].text))
            elif before is None or (after is not None and (blocks[k].heading or after - j < j - before)):
                out[k] = first[at[after]]
            elif after is None or j - before < after - j:
                out[k] = first[at[before]]
            else:
                out[k] = first[at[before]] and first[at[after]]
    return out


def main_text(page: str | None) -> str:
    """Blocks of main text in page order, joined by blank lines."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, labels(blocks)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars (its code points) in the place of html; all rows stay.

    Null html is empty, and a page without main text has an empty text. Columns named text and
    n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(*keep, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *made], [*keep, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))
