"""Main text of web pages by composite text density.

Each page becomes a small DOM. Elements that never hold article text (by tag,
role or class) are left out of all counts. A class, id or role counts by its
whole names, or by their last word if that alone says what the element is
("user-comments", "ad-slot"); a name that only has such a word in it
("has-sidebar", "related-work") marks an element if most of its text is in
links. An element
that encloses an article or main element is never left out for its tag or
names, nor is one that holds most of the page's text outside links (unless the
page has an article element elsewhere), nor a header in an article for being
one. For every other node the characters
per tag are adjusted by its links; a node's density sum adds its children's
densities. An article or main element around the node of the largest sum is
taken whole. Otherwise the least density on the path from that node to the page
body is the threshold: from the body down, every node that reaches it gives the
node of the largest sum within it. Headings right before what is taken belong
to it.

Every pattern is possessive or tried once a place, so markup of any length is
read in linear time.

Defined results: a null or empty page and one without text give the empty
string; of equal density sums the first node in page order, outer before inner,
is taken; broken markup is read as far as it goes; no text is cut; repeated rows
keep their multiplicity; nulls in other columns stay; an empty table gives an
empty table.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.S)

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var".split())
_END = {x: re.compile(rf"</{x}\b", re.I) for x in RAW}
DROP = RAW | frozenset("nav footer aside form button select option dialog menu head object audio video canvas "
                       "input datalist fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption "
                     "figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
                "th": {"tr", "table"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
                        "navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie "
                        "cookies consent notice popup modal newsletter subscribe share sharing social related "
                        "recommended comment comments disqus reply replies respond widget pagination pager login "
                        "signup search toolbar contentinfo complementary responses reviews remarks discussion".split())
# Of these, words that tell what an element is as the last word of a name.
LAST = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation "
                 "menu breadcrumb breadcrumbs sidebar cookie cookies newsletter popup modal comment comments disqus "
                 "replies responses reviews pagination pager".split())
# First words of names that tell about something else in the page.
OTHER = frozenset("has no with without not is hide show".split())
# Words that only say where or in what shape an element stands.
PLACE = frozenset("site top bottom left right inner outer wrap wrapper container box bar block area section list item "
                  "items link links primary secondary global mobile desktop widget widgets slot unit zone "
                  "space holder frame".split())
_WORD = re.compile(r"[a-z]+")
ARTICLE = frozenset(("article", "main"))
HEADER = frozenset(("header", "masthead"))
#: Why an element may be dropped.
HIDDEN, NAMED, UNSURE = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "main",
                 "why")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, main: bool = False, why: int = 0):
        self.tag, self.parent, self.drop, self.main, self.why = tag, parent, drop, main, why
        self.kids: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(tag: str) -> tuple[set[str], bool]:
    """Names in class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(tag, _NAME.match(tag).end()):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words.update(value.split())
        elif name == "hidden":
            hidden = True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return words, hidden


def _mark(names: set[str], ignore: frozenset[str] = frozenset()) -> int:
    """Whether names tell that an element is not the article: NAMED, UNSURE if
    only a part of a name does, or 0."""
    found = 0
    for name in names:
        order = _WORD.findall(name)
        words = set(order)
        if marks := words & NOT_ARTICLE - ignore:
            last = next((w for w in reversed(order) if w not in PLACE), "")
            if words <= marks | PLACE or last in LAST and order[0] not in OTHER:
                return NAMED
            found = UNSURE
    return found


def _settle(root: Node) -> None:
    """Decide which elements are dropped, from the text they enclose."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        nodes.append(x)
        if x.why != HIDDEN:  # not shown, with all it encloses
            todo.extend(k for k in x.kids if isinstance(k, Node))
    size: dict[Node, tuple[int, int, bool]] = {}  # characters, those in links, has an article
    for x in reversed(nodes):
        chars = links = 0
        main = False
        if x.why != HIDDEN:
            for k in x.kids:
                if isinstance(k, str):
                    chars += len(k.strip())
                else:
                    c, a, m = size[k]
                    chars, links, main = chars + c, links + a, main or m or k.main and k.why != HIDDEN
        size[x] = chars, chars if x.tag == "a" else links, main
    chars, links, told = size[root]
    inside: set[Node] = set()
    for x in nodes:
        if x.parent is not None and (x.parent.main or x.parent in inside):
            inside.add(x)
        if x.why and x.why != HIDDEN:
            c, a, main = size[x]
            most = 2 * (c - a) > chars - links and (not told or x in inside)  # else the article is elsewhere
            x.drop = not main and not most and (x.why != UNSURE or 2 * a > c)


def parse(page: str) -> Node:
    """A DOM of elements and text, tolerant of unclosed and stray tags."""
    root = Node("html", None)
    top, at, n = root, 0, len(page)
    opened: dict[str, int] = {}  # open elements by name: a stray end tag costs nothing

    def close(upto: Node) -> None:
        nonlocal top
        while True:
            opened[top.tag] -= 1
            done = top is upto
            top = top.parent
            if done:
                return

    def enclosing(names, stop=()) -> Node | None:
        if not any(opened.get(x) for x in names):
            return None
        x = top
        while x is not root:
            if x.tag in names:
                return x
            if x.tag in stop:
                return None
            x = x.parent
        return None

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            top.kids.append(page[at:])
            break
        if m.start() > at:
            top.kids.append(page[at:m.start()])
        at = m.end()
        raw = m[0]
        if raw[1] in "!?":
            continue
        tag = _NAME.match(raw)[1].lower()
        if raw[1] == "/":
            if tag in ("html", "body"):
                continue
            if (x := enclosing((tag,))) is not None:
                close(x)
            elif tag == "br":
                top.kids.append("\n")
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            shut = page.find(">", end.end()) if end else -1
            at = shut + 1 if shut >= 0 else n
            continue
        if tag in CLOSES_P and (x := enclosing(("p",), ("table", "td", "button"))) is not None:
            close(x)
        if tag in SELF_CLOSING:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if (x := enclosing(same, SELF_CLOSING[tag])) is not None:
                close(x)
        words, hidden = _attributes(raw) if len(raw) > len(tag) + 2 else (set(), False)
        main = tag in ARTICLE or "main" in words and "role" in raw.lower()
        inside = tag == "header" and enclosing(("article", "main")) is not None
        why = HIDDEN if hidden else NAMED if tag in DROP or tag == "header" and not inside else 0
        if not why and not main:
            why = _mark(words, HEADER if inside else frozenset())
        node = Node(tag, top, why == HIDDEN, main, why)
        top.kids.append(node)
        if tag not in VOID and not raw.endswith("/>"):
            top = node
            opened[tag] = opened.get(tag, 0) + 1
    _settle(root)
    return root


def _nodes(root: Node) -> list[Node]:
    """Kept nodes in page order, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop)
    return out


def measure(root: Node) -> list[Node]:
    """Set the counts, densities and density sums of all kept nodes."""
    nodes = _nodes(root)
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(k.strip())
            elif not k.drop:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    share = root.link_chars / max(1, root.chars)
    for x in reversed(nodes):
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        if c:
            base = math.log(c / max(1, c - x.link_chars) * x.link_chars + share * c + math.e)  # 1 at least
            x.density = c / t * math.log(max(1.0, c / lc * t / lt)) / (1.0 + math.log(base))
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.drop)
        # text of the node's own counts like a child of that length
        x.total += sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    return nodes


def select(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    nodes = measure(root)
    best = max(nodes, key=lambda x: x.total)
    up = best
    while up is not root:  # an enclosing article is taken whole
        if up.main:
            return [up]
        up = up.parent
    threshold, x = root.density, best
    while x is not root:
        threshold, x = min(threshold, x.density), x.parent
    top: dict[Node, Node] = {}  # the node of the largest sum within each
    for x in reversed(nodes):
        top[x] = x
        for k in x.kids:
            if isinstance(k, Node) and not k.drop and top[k].total > top[x].total:
                top[x] = top[k]
    taken: set[Node] = set()
    todo = [root]
    while todo:
        x = todo.pop()
        if x.density >= threshold and x not in taken:
            taken.add(top[x])
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop)
    out: list[Node] = []
    heads: list[Node] = []  # headings since the last text
    todo = [root]
    while todo:
        x = todo.pop()
        if x in taken:
            out += [*heads, x]
            heads = []
        elif x.tag in HEADINGS:
            heads.append(x)
        else:
            if any(isinstance(k, str) and k.strip() for k in x.kids):
                heads = []
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop)
    return out


def text_of(*nodes: Node) -> str:
    """Text of subtrees: blocks in page order joined by one space."""
    out: list[str] = []
    todo: list = [x for node in reversed(nodes) for x in (node, " ")]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            if x.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.kids))
    return " ".join(html.unescape("".join(out)).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return text_of(*select(root))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``id_col``, ``url_col``, text, n_chars (code points)."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, schema)
