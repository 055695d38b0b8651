"""Main text of web pages, with the templates of their sites removed.

Pages become element trees. Subtrees are hashed with their text and counted per
host and kind of page (with or without an article) in Spark; what recurs on a share
of a kind's different pages, or as a box on a fixed number of them, is template and
goes, as do elements whose name, role or class says that they are not the article. Inside
an article only boxes can be template, not its paragraphs: pages may quote each other.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MIN_PAGES, MIN_SHARE = 3, 0.3
MIN_PAGES_INSIDE, MIN_SHARE_INSIDE = 8, 0.6
ENOUGH = 50  # so many different pages suffice for a box, whatever their share
SPREAD = 16  # tasks that share the pages of one host

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# fixed values of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head option optgroup legend td th tr tbody thead tfoot".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "tr"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FENCE = frozenset("table ul ol dl td th article section div body html main aside nav header footer form blockquote select".split())
NEVER = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav header footer aside form button select textarea input dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navs|navbar|navigation|menus?|menubar|topbar|toolbar|sidebars?|sidenav|site-?header|page-?header|masthead|header|footers?|footnav|colophon|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletters?|subscribe|subscription|signup|login|search|share|sharing|social|comments?|commentlist|disqus|replies|respond|breadcrumbs?|related|recommended|pagination|pager|widgets?|skip-?link|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
DISCUSSION = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?=$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# pieces of a box: they need a share
PIECES = frozenset("html body tr tbody thead tfoot caption figcaption summary legend".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt b i em strong a span br code sub sup q cite small u s mark abbr time td th".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "size")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.kids: list[Node | str] = []

    def hinted(self, name: str, value: str, inside: bool) -> bool:
        """Does a class or id tell that this is not the article?"""
        if inside and self.tag in TEXTUAL or name == "id" and self.tag in HEADINGS:
            return False
        by_title = inside and name == "id" and self.tag == "section"
        return (DISCUSSION if by_title else HINT).search(value) is not None

    def unwanted(self, inside: bool = False) -> bool:
        """``inside``: the element lies within an article."""
        if self.tag in NEVER:
            return True
        if not self.attrs or self.tag in ("html", "body", "article", "main"):
            # a class on these names the page, but comments may be articles too
            return self.tag == "article" and "comment" in self.attrs.lower()
        for name, *values in ATTR.findall(self.attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id") and self.hinted(name, value, inside) or name == "role" and value.strip().lower() in ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                return True
        return False


def parse(text: str) -> Node:
    """Element tree of a page, however broken: end tags without a start are left out,
    missing ones are put where the next element implies them or at the end."""
    root = Node("#root", "")
    stack = [root]
    at, n = 0, len(text)

    def close(names: tuple[str, ...], fence: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in fence:
                return

    while at < n:
        m = TAG.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(entities.escape(m[0][9:-3]))
            continue
        if m[1] or m[4]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p", ""))
            else:
                close((tag,), frozenset() if tag in FENCE else FENCE - {tag})
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in CLOSES_P:
            close(("p",), FENCE)
        if tag in SIBLING:
            for _ in range(3 if tag in ("tr", "tbody", "thead", "tfoot") else 1):
                close(SIBLING[tag], frozenset(("table", "ul", "ol", "dl", "select")))
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            if end is None:
                if tag in ("script", "style", "textarea", "title", "noscript", "template", "svg"):
                    at = n
                continue
            close_at = text.find(">", end.start())
            at = n if close_at < 0 else close_at + 1
            continue
        stack.append(node)
    return root


def sign(root: Node) -> list[Node]:
    """All elements, children before parents, each with a hash of its tag, attributes,
    text and children, and the length of its text."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node)]
    order.reverse()
    for x in order:
        h = xxhash.xxh3_64(f"{x.tag} {x.attrs.strip()}".encode("utf-8", "surrogatepass"))
        x.size = 0
        for k in x.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "little"))
                x.size += k.size
            elif t := " ".join(k.split()):
                h.update(b"\0" + t.encode("utf-8", "surrogatepass"))
                x.size += len(t)
        x.hash = h.intdigest()
    return order


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url or "").hostname or "").lower() or None
    except ValueError:
        return None


def bodies(root: Node) -> tuple[list[Node], bool]:
    """The outermost wanted article elements (or main elements), or the whole page."""
    for names in (("article",), ("main",)):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag in names or names == ("main",) and re.search(r"role\s*=\s*[\"']?main\b", x.attrs):
                if not x.unwanted() and x.size:
                    found.append(x)
                continue
            if x is root or not x.unwanted():
                todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
        if found:
            return found, True
    return [root], False


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def candidates(text: str) -> tuple[int, bool, list[int], list[int]]:
    """Hash of the page; if it has an article; hashes of the subtrees that may be template
    (inside the article, if there is one, not the textual ones): pieces, then boxes."""
    root = parse(text)
    sign(root)
    tops, inside = bodies(root)
    pieces: set[int] = set()
    seen: set[int] = set()
    todo = [k for t in tops for k in t.kids if isinstance(k, Node)]
    while todo:
        x = todo.pop()
        if x.unwanted(inside):
            continue
        if x.size and not (inside and x.tag in TEXTUAL):
            (pieces if x.tag in TEXTUAL or x.tag in PIECES else seen).add(_signed(x.hash))
        todo += [k for k in x.kids if isinstance(k, Node)]
    return _signed(root.hash), inside, sorted(pieces), sorted(seen)


def main_text(text: str, template: frozenset[int] = frozenset(), boxes: frozenset[int] = frozenset()) -> str:
    """The wanted text: character references decoded, white space as one space.
    ``template`` holds for pages without an article, ``boxes`` inside articles."""
    root = parse(text)
    sign(root)
    out: list[str] = []
    tops, inside = bodies(root)
    gone = boxes if inside else template
    todo: list[Node | str | None] = list(reversed(tops))
    tops_set = {id(t) for t in tops}
    while todo:
        x = todo.pop()
        if x is None:
            out.append(" ")
        elif isinstance(x, str):
            out.append(entities.unescape(x))
        elif id(x) not in tops_set and (x.unwanted(inside) or _signed(x.hash) in gone and not (inside and x.tag in TEXTUAL)):
            out.append(" ")
        else:
            block = x.tag in BLOCK or id(x) in tops_set
            if block:
                out.append(" ")
                todo.append(None)
            todo += reversed(x.kids)
    return " ".join("".join(out).split())


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """_host, _template, _boxes (inside articles): the subtree hashes that recur on many different pages of a
    host, of all its pages with an article or of all without. A page counts once however often it is stored; at
    most the subtrees of a few pages can have a share, and boxes need ENOUGH pages, so the list of a host is short."""

    def setup():
        def step(b):
            got = [candidates(t or "") for t in b["_html"]]
            return {"_host": [host_of(u) for u in b["_url"]], **{c: [g[i] for g in got] for i, c in enumerate(("_page", "_inside", "_pieces", "_whole"))}}

        return step

    own = pages.select(F.col(url).alias("_url"), F.col(html).alias("_html"))
    seen = map_batches(own, "_host string, _page long, _inside boolean, _pieces array<long>, _whole array<long>", setup).where("_host is not null")
    trees = seen.select("_host", "_page", "_inside", F.explode(F.concat(F.transform("_pieces", lambda h: F.struct(h.alias("h"), F.lit(False).alias("box"))), F.transform("_whole", lambda h: F.struct(h.alias("h"), F.lit(True).alias("box"))))).alias("_t"))
    counted = trees.select("_host", "_page", "_inside", "_t.h", "_t.box").distinct().groupBy("_host", "h", "_inside", "box").agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_PAGES)
    kinds = seen.select("_host", "_page", "_inside").distinct().groupBy("_host", "_inside").agg(F.count("*").alias("_pages"))
    share = F.when(F.col("_inside"), (F.col("_n") >= MIN_PAGES_INSIDE) & (F.col("_n") >= F.col("_pages") * MIN_SHARE_INSIDE)).otherwise(F.col("_n") >= F.col("_pages") * MIN_SHARE)
    found = counted.join(kinds, ["_host", "_inside"]).where(share | F.col("box") & (F.col("_n") >= ENOUGH))
    return found.groupBy("_host").agg(F.collect_set(F.when(~F.col("_inside"), F.col("h"))).alias("_template"), F.collect_set(F.when(F.col("_inside"), F.col("h"))).alias("_boxes"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``, repeated rows
    included. Null or empty html gives an empty text; pages without a host have no
    template. Without an article or main element the whole page is read."""
    host = F.udf(host_of, "string", useArrow=True)
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    # the pages of one host are dealt over SPREAD tasks, each with the host's list
    own = own.withColumn("_host_of", host("url")).withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)))
    lists = templates(pages, url, html).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    both = own.join(lists, (F.col("_host_of") == F.col("_host")) & (F.col("_part") == F.col("_piece")), "left")

    def setup():
        def step(b):
            text = [main_text(t or "", frozenset(x or ()), frozenset(y or ())) for t, x, y in zip(b["_html"], b["_template"], b["_boxes"], strict=True)]
            return {"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}

        return step

    return map_batches(both.select("page_id", "url", "_html", "_template", "_boxes"), "page_id long, url string, text string, n_chars long", setup)
