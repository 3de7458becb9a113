"""Main text of web pages by removal of site templates: element subtrees that recur across a host's pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import cut, in_arrow, lookup, texts_of

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that carry running text; a container that holds one may be a story.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "figcaption"}
#: Elements that are a page's frame.
FRAME = {"#root", "html", "body", "article", "main"}
#: Elements that are never part of an article.
FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "input", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
#: Words that, as a whole class or id or with words of PLACES only, name furniture anywhere.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "popup", "modal", "subscribe", "subscription", "newsletter", "signup", "login", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sidebar", "masthead", "topbar", "comment", "comments", "commentlist", "respond", "disqus", "replies", "share", "sharing", "social",
}
#: Words that name furniture outside an article only.
OUTSIDE = {"header", "footer", "foot", "banner", "alert", "widget", "widgets", "related", "recommended", "recommendations", "copyright", "legal", "disclaimer", "search", "toolbar", "overlay", "side", "rail", "skip", "tags"}
PLACES = {"site", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "box", "slot", "unit", "block", "bar", "area", "wrap", "wrapper", "container", "inner", "outer", "list", "section", "widget", "banner", "links", "link", "form", "text", "item"}
#: Start tags that end an open p, and which open siblings they end.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: How a subtree's recurrence is judged, by where it stands: (different contents that it stands beside on its host at
#: least, share of the host's contents at least).
PLAIN, TEXT, INSIDE = 0, 1, 2
RECURS = {PLAIN: (3, 0.0), TEXT: (3, 0.3), INSIDE: (20, 0.5)}
# a quote opens a string only right after "=", and only if it is closed; else the value ends at white space or ">"
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>=]+|=\s*{_VALUE}|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("children", "drop", "hash", "inside", "name", "text")

    def __init__(self, name: str, drop: bool = False, inside: bool = False):
        self.name, self.children, self.drop, self.inside, self.hash, self.text = name, [], drop, inside, 0, False


def names_furniture(token: str, inside: bool) -> bool:
    """Whether a whole class or id names furniture: related-work and search-term don't, comment-list and adSlot3 do."""
    words = [w.lower() for w in _NAME.findall(token)]
    own = NAMES if inside else NAMES | OUTSIDE
    return any(w in own for w in words) and all(w in own or w in PLACES or w.isdigit() for w in words)


def is_furniture(name: str, attributes: str, inside: bool) -> bool:
    """inside: in an article or main element, where a header is the article's own."""
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if not attributes or name in FRAME:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or (key == "role" and value.lower() in ROLES) or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name not in INLINE and not (len(name) == 2 and name[0] == "h") and any(names_furniture(t, inside) for t in value.split()):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree: strings and nodes. Tags that are never closed end with their parent; stray end tags are ignored."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            names = [x.name for x in stack]
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                if name not in INLINE or not any(x not in INLINE for x in names[k + 1 :]):
                    del stack[k:]  # an inline end tag doesn't close the blocks opened since
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name not in INLINE:
                    break
        if same := ENDS_SAME.get(name):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in same:
                    del stack[k:]
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
                    break
        inside = stack[-1].inside or stack[-1].name in ("article", "main")
        node = Node(name, is_furniture(name, m.group(3), inside), inside)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:  # its content is no markup; it ends with its own end tag only
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not m.group(3).rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(node)
    return root


def subtrees(root: Node) -> Iterator[Node]:
    """Elements children first, each with the hash of its name, text and subtrees, and whether it holds running text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if c.__class__ is Node]
    for node in reversed(order):
        h, node.text = xxhash.xxh64(node.name.encode()), node.name in PROSE
        for c in node.children:
            if c.__class__ is Node:
                h.update(c.hash.to_bytes(8, "little"))
                node.text |= c.text
            else:
                h.update(" ".join(c.split()).encode("utf-8", "replace"))
            h.update(b"\0")
        node.hash = h.intdigest()
        yield node


def kind(node: Node) -> int:
    return INSIDE if node.inside else PLAIN if node.drop or not node.text else TEXT


def key(node: Node) -> int:
    """The hash, its lowest two bits replaced by the kind: a subtree is counted by where it stands. As a signed long."""
    h = node.hash & ~3 | kind(node)
    return h - (1 << 64) if h >> 63 else h


def candidates(root: Node) -> list[Node]:
    """The subtrees that may be a site's template, parents first: all but the frame, empty elements, what stands inside
    an element that is dropped by name, and inline elements, unless they stand loose in the page."""
    for _ in subtrees(root):
        pass
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and node.children and node.name not in FRAME:
            found.append(node)
        if not node.drop:
            loose = node.name in FRAME
            todo += [c for c in reversed(node.children) if c.__class__ is Node and (loose or c.name not in INLINE)]
    return found


#: Key of the page itself among its subtrees' keys.
PAGE = 0
#: The longest texts of a page that make up so much of it are what it holds; the rest may change without being another.
BULK = 0.9


def contents(root: Node) -> dict[int, int]:
    """Key -> what the page holds beside that subtree, as a hash, for the subtrees that have at least as much text beside
    them as in them; PAGE -> what it holds. Text in links counts as none, that in elements dropped by name isn't there.

    So pages that differ in little but a changing line hold the same, and a subtree that is most of its page's text, as a
    story is, is never judged by that page."""
    found = candidates(root)
    texts: list[tuple[int, int]] = []  # (length, hash) of each piece of text, in page order
    span: dict[int, tuple[int, int]] = {}
    todo: list = [(root, False, False)]
    while todo:
        node, linked, closing = todo.pop()
        if node.__class__ is str:
            if piece := " ".join(node.split()):
                texts.append((0 if linked else len(piece), xxhash.xxh64_intdigest(piece.encode("utf-8", "replace"))))
        elif closing:
            span[id(node)] = (span[id(node)][0], len(texts))
        else:
            span[id(node)] = (len(texts), len(texts))
            if not node.drop:
                todo.append((node, linked, True))
                todo += [(c, linked or node.name == "a", False) for c in reversed(node.children)]
    total, least, covered = sum(n for n, _ in texts), 0, 0
    for n, _ in sorted(texts, reverse=True):
        if covered >= BULK * total:
            break
        least, covered = n, covered + n
    lengths, held = [0], [0]
    for n, h in texts:
        lengths.append(lengths[-1] + n)
        held.append((held[-1] + h * (n >= least)) % (1 << 61))
    out = {PAGE: held[-1]}
    for node in found:
        first, last = span.get(id(node), (0, 0))
        inside = lengths[last] - lengths[first]
        if total - inside >= inside:
            out[key(node)] = (held[-1] - held[last] + held[first]) % (1 << 61)
        else:
            out.setdefault(key(node), -1)
    return out


def remove(root: Node, template: set[int]) -> int:
    """Marks the outermost subtrees whose key is in template as dropped; their number."""
    n, below = 0, set()
    for node in candidates(root):
        if id(node) in below:
            pass
        elif key(node) in template:
            node.drop = True
            n += 1
        else:
            continue
        below.update(id(c) for c in node.children if c.__class__ is Node)
    return n


def blocks_of(top: Node) -> list[str]:
    """Blocks in page order, without what is dropped."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join(html.unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    todo: list = [(top, False)]
    while todo:
        node, closing = todo.pop()
        if node.__class__ is str:
            line.append(node)
        elif closing:
            end()
        elif node.drop:
            if node.name not in INLINE:
                end()
        else:
            if node.name == "br":
                line.append("\n")
            elif node.name not in INLINE:
                end()
                todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
    end()
    return blocks


def marked(root: Node) -> list[Node]:
    """The outermost main and article elements that are not dropped."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop and node.name in ("article", "main"):
            found.append(node)
        elif not node.drop:
            todo += [c for c in reversed(node.children) if c.__class__ is Node]
    return found


def holds_prose(top: Node) -> bool:
    """Whether an element that isn't dropped, in top or below, carries running text."""
    todo = [top]
    while todo:
        node = todo.pop()
        if not node.drop:
            if node.name in PROSE:
                return True
            todo += [c for c in node.children if c.__class__ is Node]
    return False


def main_text(root: Node) -> str:
    """The text of the page without what is dropped: that of main, or of the one article, if it holds running text,
    however much stands beside it (such as readers' talk). Several articles, or one without any running text, may be
    teasers of a story that stands beside them: they alone are the text only if no more than that is elsewhere."""
    own = marked(root)
    inner = " ".join(x for node in own for x in blocks_of(node))
    told = [node for node in own if holds_prose(node)]
    if inner and told and (len(own) == 1 or any(node.name == "main" for node in told)):
        return inner
    whole = " ".join(blocks_of(root))
    return inner if own and len(inner) * 2 >= len(whole) else whole


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(seen: DataFrame, recurs: dict[int, tuple[int, float]] | None = None) -> tuple[DataFrame, int]:
    """seen (host, keys, beside) -> (host, key, n), the subtrees that stand beside enough different contents on their
    host, and how many subtrees there are in all."""
    recurs = recurs or RECURS
    each = seen.select("host", F.inline(F.arrays_zip("keys", "beside"))).where(F.col("beside") >= 0)
    counts = cut(each.distinct().groupBy("host", F.col("keys").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.where(F.col("key") == PAGE).select("host", F.col("n").alias("total"))
    size = totals.agg(F.sum("total")).first()[0] or 0
    with_total = lookup(counts.where((F.col("key") != PAGE) & (F.col("n") >= 2)), totals, ["host"], "total", size, F.col("key"))
    of_kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in recurs.items() for x in (k, float(v[i]))]), F.col("key").bitwiseAND(F.lit(3)).cast("int"))
    inside = F.col("key").bitwiseAND(F.lit(3)) == INSIDE
    least = F.when(inside, of_kind(0)).otherwise(F.least(of_kind(0), F.col("total")))  # on a host of two contents, two
    found = with_total.where((F.col("n") >= least) & (F.col("n") >= F.col("total") * of_kind(1)))
    return found.select("host", "key", "n"), seen.agg(F.sum(F.size("keys"))).first()[0] or 0


def extract(pages: DataFrame, recurs: dict[int, tuple[int, float]] | None = None, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_removed (outermost subtrees removed as the host's template).

    Each page's subtree hashes are counted per host, by the different contents that they stand beside (see `contents`):
    copies of a page, and pages that differ in a changing line only, count once, and a story is no template of the URLs
    that have it. Those that recur are removed, by RECURS: containers without running text from 3 contents on (2 on a
    host that has no more), running text outside a marked article if beside 30 % of the host's contents too, as stories
    may quote each other, and what stands inside a marked article from 20 and half of all on. What HTML itself names as
    no content goes, and elements whose whole class or id names furniture.

    Counting combines on the map side, no host's template is ever held in one place, and a page meets the removed
    subtrees of its own only. Null and empty html give an empty text. A null url is the host "". Repeated rows come
    back repeated; an empty table gives no rows. Very long pages are worked on whole, in time that grows with their
    length. Other columns of pages, whatever their names, play no part.
    """
    base = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("row", F.xxhash64("page_id", "url", "html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [contents(parse(page)) for page in texts_of(b.column(2))]
            keys, beside = [list(f) for f in found], [list(f.values()) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(beside, pa.list_(pa.int64()))], names=["row", "host", "keys", "beside"])

    seen = cut(base.select("row", F.xxhash64(host(F.col("url"))).alias("host"), "html").transform(in_arrow, hashes, "row long, host long, keys array<long>, beside array<long>"))
    found, total = templates(seen, recurs)
    found = cut(found)
    met = lookup(seen.select("row", "host", F.explode("keys").alias("key")).where(F.col("key") != PAGE), found, ["host", "key"], "n", total, F.col("row"))
    marks = met.groupBy("row").agg(F.collect_set("key").alias("template"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, removed = [], []
            for page, own in zip(texts_of(b.column(2)), b.column(3)):
                root = parse(page)
                template = own.as_py()
                removed.append(remove(root, set(template)) if template else 0)
                out.append(main_text(root).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_removed"])

    joined = base.join(marks, "row", "left").select("page_id", "url", "html", "template")
    return joined.transform(in_arrow, texts, "page_id long, url string, text string, n_removed long")
