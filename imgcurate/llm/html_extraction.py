"""Main text of web pages, with templates found by their repetition on a host.

Each page is read into elements, and each element's subtree is hashed with its tag, classes,
links and text. Spark counts on how many pages of its host a subtree recurs. A subtree that
recurs on many of them is part of the site's template and goes, with all below it. The main
elements of a page (``article``, ``main``) are what templates surround and are never taken for one.
Boxes inside them are counted once for each different main element, so copies of an article stay
whole. Parts that are never text (menus, headers, footers, forms, adverts, comments and so on)
are known by their tags, roles and classes and go anyway.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from imgcurate.session import written

from .arrow import slices
from .registry import query, table

#: A subtree is a template's if it is on so many pages of a host, and on this share of them.
PAGES = 5
SHARE = 0.2

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "input", "dialog", "menu",
    "svg", "math", "canvas", "audio", "video", "object", "embed", "template", "datalist", "map",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
CLASSES = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisements?|adsbygoogle|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|widgets?|"
    r"cookies?|consent|gdpr|notices?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption)|sign-?up|log-?in|share|sharing|social|"
    r"comments?(?:list|form)?|disqus|replies|respond|related|recommend(?:ed|ations)?|footer|masthead|skip-?link|pagination|pager)(?:$|[-_ ])",
    re.I,
)
#: Words that may stand beside one of the above in a name inside a main element; others make it a name of the article's own.
BESIDE = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "header", "inline", "inner", "item", "items",
    "left", "links", "list", "main", "outer", "panel", "post", "posts", "right", "section", "slot", "stories", "top", "unit", "wrap", "wrapper",
}
MAIN = {"article", "main"}
#: Elements inside main ones that may be a template's, or go by their names as lists do. Paragraphs and tables there are text.
BOXES = {"div", "section", "figure", "details", "ins", "span"}
LISTS = {"ul", "ol"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEPT = MAIN | {"html", "body"}
HIDDEN = re.compile(r"display\s*:\s*none")
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "head", "nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu",
}
#: Elements that end where one of these begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?/][^>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)


class Element:
    """``main`` is the outermost main element around, ``size`` the length of the text below once hashed."""

    __slots__ = ("tag", "signs", "gone", "children", "hash", "size", "main")

    def __init__(self, tag: str, signs: str = "", gone: bool = False, main: Element | None = None):
        self.tag, self.signs, self.gone, self.main = tag, signs, gone, main
        self.children, self.hash, self.size = [], 0, 0


def _names_part(name: str) -> bool:
    """Whether a name inside a main element is one of a part that is not text: all its words are known."""
    words = [w for w in re.split(r"[-_]", name.lower()) if w and not w.isdigit()]
    return any(map(CLASSES.fullmatch, words)) and all(w in BESIDE or CLASSES.fullmatch(w) for w in words)


def _signs(tag: str, attributes: str, inside: bool = False) -> tuple[str, bool]:
    """What tells an element from others of its tag, and whether it is never text."""
    held = {a.lower(): unescape((v or "").strip("\"'")) for a, v in ATTRIBUTE.findall(attributes)}
    names = f"{held.get('class', '')} {held.get('id', '')}"
    gone = "hidden" in held or held.get("aria-hidden") == "true" or bool(HIDDEN.search(held.get("style", "")))
    gone = gone or held.get("role", "").lower() in ROLES
    if inside:
        gone = gone or (tag in BOXES | LISTS and any(map(_names_part, names.split())))
    else:
        gone = gone or (tag not in KEPT and bool(CLASSES.search(names)))
    return f"{names}|{held.get('href', '')}|{held.get('src', '')}", gone


def parse(html: str) -> tuple[Element, set[int], list[Element]]:
    """The tree of a page, the ids of its main elements and of all above one, and the boxes inside them.

    Missing and stray end tags are mended roughly as browsers do.
    """
    held: set[int] = set()
    boxes: list[Element] = []
    root = Element("#root")
    stack = [root]
    last = root.children
    tokens = TOKEN.finditer(html)
    titles: list[Element] = []  # headers of main elements: text if a heading is in them
    while (m := next(tokens, None)) is not None:
        end, name, attributes = m.groups()
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                last.append(text)
            continue
        name = name.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k].tag
                if tag == name:
                    del stack[k:]
                    break
                if name not in BLOCKS and tag in BLOCKS:
                    break  # an inline end tag does not end blocks
            last = stack[-1].children
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES[name]:
                    break
        above = stack[-1]
        main = above.main or (above if above.tag in MAIN and not above.gone else None)
        signs, gone = _signs(name, attributes, main is not None) if attributes else ("", False)
        element = Element(name, signs, gone or name in DROPPED, main)
        above.children.append(element)
        if name in MAIN and not element.gone:
            held.update(map(id, stack), [id(element)])
        if main is not None:
            if name in BOXES and not element.gone:
                boxes.append(element)
            elif name == "header" and not gone:
                titles.append(element)
            elif name in HEADINGS and titles:
                for e in stack:
                    if e.tag == "header" and any(e is t for t in titles[-8:]):
                        e.gone = False
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, m.end())
            element.children.append(html[m.end() : stop.start() if stop else len(html)])
            tokens = TOKEN.finditer(html, stop.end() if stop else len(html))
        elif name not in VOID:
            stack.append(element)
        last = stack[-1].children
    return root, held, boxes


def walk(root: Element, inside: bool) -> list[Element]:
    """The elements, parents first, those of main elements only if ``inside``; without recursion, as pages may be nested deeply."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        if inside or e.gone or e.tag not in MAIN:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def hash_subtrees(order: list[Element]) -> None:
    """Hashes and lengths of the subtrees of ``order``, in which parents come first."""
    for e in reversed(order):
        parts = []
        for c in e.children:
            if isinstance(c, Element):
                parts.append(f"{c.hash:016x}")
                e.size += 0 if c.gone else c.size
            else:
                parts.append(" ".join(c.split()))
                e.size += len(parts[-1])
        e.hash = xxh64_intdigest("\x00".join([e.tag, e.signs, *parts]).encode("utf-8", "surrogatepass"))


def _may_recur(root: Element, held: set[int], boxes: list[Element]) -> list[tuple[Element, int | None]]:
    """Subtrees that may be a template's: outside main elements, and boxes inside with the hash of the main element around.

    A subtree outside holds no main element. A box holds none either, and less than half of the text of the one around.
    """
    order = walk(root, bool(boxes))
    hash_subtrees(order)
    whole = ("#root", "html", "body")
    out = [(e, None) for e in order if e.main is None and id(e) not in held and e.children and e.tag not in RAW and e.tag not in whole]
    return out + [(e, e.main.hash) for e in boxes if id(e) not in held and e.children and 2 * e.size < e.main.size]


def candidates(html: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Hashes of the subtrees that may be a template's, each once: those outside main elements, and boxes with the main element around them."""
    found = _may_recur(*parse(html))
    return list({_signed(e.hash) for e, around in found if around is None}), list({(_signed(e.hash), _signed(around)) for e, around in found if around is not None})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def main_text(html: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the page's main elements, joined by newlines.

    The whole page counts if it has none, or only articles that hold less text than what is
    around them, as cards that lead to other pages do.
    """
    root, held, boxes = parse(html)
    if templates:
        for e, _ in _may_recur(root, held, boxes):
            e.gone |= _signed(e.hash) in templates
    # Blocks as whether they are in a main element, and their text. Ends of blocks are on the stack as None.
    blocks: list[tuple[bool, list[str]]] = [(False, [])]
    sure = False
    todo: list = [(root, False)]
    while todo:
        e, counts = todo.pop()
        if e is None:
            blocks.append((counts, []))
        elif isinstance(e, str):
            blocks[-1][1].append(unescape(e))
        elif e.gone:
            if e.tag in BLOCKS:
                blocks.append((counts, []))
        else:
            if e.tag == "br":
                blocks[-1][1].append(" ")
            if e.tag in BLOCKS:
                todo.append((None, counts))
                sure |= e.tag == "main"
                counts = counts or e.tag in MAIN
                blocks.append((counts, []))
            todo += [(c, counts) for c in reversed(e.children)]
    told = [(counts, t) for counts, b in blocks if b and (t := " ".join("".join(b).split()))]
    if not sure:
        own = sum(len(t) for counts, t in told if counts)
        sure = own > 0 and own >= sum(len(t) for counts, t in told if not counts)
    return "\n".join(t for counts, t in told if counts or not sure)


def _host():
    """Scheme, user, port and case aside; a null or odd address is a host of its own kind."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates_of(pages: DataFrame, min_pages: int = PAGES, min_share: float = SHARE) -> DataFrame:
    """``(host, subtree)``: subtrees on at least ``min_pages`` pages of a host and ``min_share`` of them.

    Inside main elements pages with the same main element count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                own = [candidates(h or "") for h in part.column("html").to_pylist()]
                boxes = [[{"subtree": a, "around": b} for a, b in inside] for _, inside in own]
                kind = pa.list_(pa.struct([("subtree", pa.int64()), ("around", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array([outside for outside, _ in own], pa.list_(pa.int64())), pa.array(boxes, kind)], names=["host", "subtrees", "boxes"]
                )

    seen = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, subtrees array<long>, boxes array<struct<subtree: long, around: long>>")
    seen = written(seen, "subtrees-seen")
    # The null subtree counts the pages themselves, so that one pass gives both numbers.
    counted = seen.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "subtrees")).alias("subtree")).groupBy("host", "subtree").count()
    inside = seen.select("host", F.explode("boxes").alias("box")).select("host", "box.*").distinct().groupBy("host", "subtree").count()
    counted = written(counted.unionByName(inside).where((F.col("count") >= min_pages) | F.col("subtree").isNull()), "subtrees")
    total = counted.where("subtree is null").select("host", F.col("count").alias("pages"))
    many = counted.where("subtree is not null").join(total, "host").where(F.col("count") >= F.col("pages") * min_share)
    return written(many.select("host", "subtree").distinct(), "templates")


def extract(pages: DataFrame, min_pages: int = PAGES, min_share: float = SHARE, out: str = "text") -> DataFrame:
    """``pages`` with their main text in ``out``; every row comes out once, others columns unchanged.

    A null or empty page has an empty text. A null ``url`` counts as a host with an empty name.
    Repeated rows count as pages of their own and have equal results. An empty table gives an
    empty one. A column named ``out`` is replaced. Pages of one host meet its templates in a
    join, whose hot hosts are split by size at run time.
    """
    own = [c for c in pages.columns if c != out]
    rows = pages.select(F.struct(*own).alias("row"), _host().alias("host"), "html")
    found = templates_of(pages, min_pages, min_share)
    # What a host's pages are compared with: a bounded number of subtrees, as each is on a share of its pages.
    lists = written(found.groupBy("host").agg(F.collect_list("subtree").alias("templates")), "template-lists")
    schema = rows.select("row").schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                templates = part.column("templates").to_pylist()
                texts = [main_text(h or "", set(t or ())) for h, t in zip(part.column("html").to_pylist(), templates, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", out])

    made = rows.join(lists, "host", "left").select("row", "html", "templates").mapInArrow(run, schema)
    return made.select(*[F.col("row")[c].alias(c) for c in own], out)


@query("op7_html_extraction")
def op7_html_extraction(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
