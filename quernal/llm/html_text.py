"""The main text of web pages by composite text density.

A page becomes a tree of elements (void elements, implied end tags, raw text, unclosed and cut-off markup are provided for).
Every node gets its composite density: characters per tag, where the logarithm's base and argument grow with the share of characters
and tags that belong to links, so that menus score near 0. A node's density sum is that of its children. The threshold is the least
density on the path from the node of the largest sum up to the body, with the body. From the body down, the largest sum within each
node at or above the threshold marks a piece of content; so does loose text (text and inline elements between blocks) of that density.
The pieces are the main text; the one of the largest sum is widened to the article or main element around it, for a title is
too short for a density of its own. Outside that element pieces must reach the least density on the path below the body, but in other
article or main elements. All blocks there are returned in page order, but for subtrees that are no article by their element or role.

A class or id is evidence for a density only: the text under one that speaks of menus, adverts, notices or comments counts as link text,
so its density falls to 0, and what falls below the threshold goes. That is so of names whose words all say so where the subtree is mostly links or a small
share of the page, and of names with other words besides (has-sidebar, related-work) where it is mostly links; of readers' comments, as
dense as any text, where the page has other text. It is never so of a subtree that holds an article or main element (but one of mostly links),
nor, but for comments, of one that holds the largest sum. Where the body itself is the piece, lists of links that it begins with go too.

Character references are decoded, white space within a block (any that Unicode knows, and <br>) becomes one space, blocks are
trimmed, empty ones dropped, and joined by a blank line. Null and empty pages, and pages of such subtrees only, give "". Rows that
repeat are extracted alike; of equal sums the node nearest the page's beginning and its root counts. An empty table gives no rows; columns
are found by position, so names that clash do no harm. Time is linear in the page, however its tags are left open or unmatched.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quernal.llm.common import packed, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br object param".split())
#: Elements of formulas, inline too; they are no tags to the densities.
MATH = frozenset("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction".split())
#: Elements that are no part of an article, with all they hold.
OUTSIDE = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe embed svg canvas audio video dialog menu annotation annotation-xml".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of a class or id that say so.
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar "
    "share sharing social related recommended recommendations comment comments commentlist disqus replies respond search pagination pager toolbar widget widgets skip".split()
)
#: Words that say so outside an article only.
OUTSIDE_PAGE_WORDS = frozenset(["header", "head", "top"])
#: Words of those about what readers write.
DISCUSSION = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that add nothing to those.
GENERIC = frozenset("list area section box block wrap wrapper container bar item items inner link links button buttons form group panel icon icons posts post articles stories site main primary secondary global left right top bottom header body thread toggle".split())
#: Those that count on an article or main element.
OUTSIDE_MAIN_WORDS = frozenset("comment comments ad ads advert related".split())
#: What a class or id says of its element: some of its words, all of its words, all and that readers wrote it.
SOME, ALL, READERS = 1, 2, 3
#: A subtree is of mostly links from such a share of its characters, in an article or main element from the second.
MOSTLY, MOSTLY_IN_MAIN = 0.5, 0.8
#: A share of the page's characters below the first is small; readers' comments of the second or more are the page.
SMALL, WHOLE = 1 / 3, 0.9
#: So many times the characters of the largest article or main element are small outside all of them.
BESIDE = 4
MAIN = frozenset(["article", "main"])
#: What a page of one piece begins with is a list of links from so many links and such a share of its characters.
LINKS, LINK_SHARE = 3, 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends an open <p>, and what ends its own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: No implied end goes beyond these.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
TABLE_SCOPE = frozenset(["table", "html", "body"])
P_SCOPE = frozenset("html body table td th caption button object article section div main aside nav header footer li ul ol blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|<[!?/](?![a-zA-Z\[])[^>]*+(?:>|\Z)|<!(?:\[CDATA\[.*?(?:\]\]>|\Z)|[^>]*+(?:>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
#: One attribute: its name, then its whole value, so that the next match starts at a name again.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "main", "doubt", "weak", "chars", "tags", "link_chars", "link_tags", "linked", "inline", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool, main: bool, doubt: int = 0):
        self.tag, self.parent, self.out, self.main, self.doubt = tag, parent, out, main, doubt
        self.children: list[Node | str] = []
        self.weak = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.inline = tag in INLINE or tag in MATH
        self.density = self.total = 0.0


def _outside(tag: str, rest: str, in_main: bool) -> tuple[bool, int]:
    """Whether an element is no part of an article, and what its class and id say."""
    if tag in OUTSIDE or (tag == "header" and not in_main):
        return True, 0
    doubt = 0
    if "=" not in rest and "hidden" not in rest.lower():
        return False, doubt
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, 0
        if name == "role":
            if value.lower() in OUTSIDE_ROLES:
                return True, 0
        elif (name == "class" or (name == "id" and tag not in HEADINGS)) and tag not in ("body", "html"):
            said = max((_said(x, tag, in_main) for x in value.split()), default=0)
            # The id of a section of an article is made of its heading.
            doubt = max(doubt, SOME if said == ALL and name == "id" and tag == "section" and in_main else said)
    return False, doubt


def _said(token: str, tag: str, in_main: bool) -> int:
    words = {w.lower() for w in _WORD.findall(token)}
    if tag in MAIN:
        found = words & OUTSIDE_MAIN_WORDS
    else:
        found = words & OUTSIDE_WORDS or (frozenset() if in_main else words & OUTSIDE_PAGE_WORDS)
    if not found:
        return 0
    if not words <= OUTSIDE_WORDS | OUTSIDE_PAGE_WORDS | GENERIC:
        return 0 if tag in MAIN else SOME
    return READERS if found & DISCUSSION else ALL


class _Open:
    """The open elements, innermost last, and the depths of those of each tag: no search walks up the tree."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, tags) -> int:
        """The depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, tags, scope=()) -> None:
        """End the innermost element of these tags, with all it holds, unless one of scope stands within it."""
        depth = self.innermost(tags)
        if depth and depth > self.innermost(scope):
            while len(self.nodes) > depth:
                self.depths[self.nodes.pop().tag].pop()


def parse(text: str) -> Node:
    """The tree of a page; text stands among a node's children as strings, still with its character references."""
    root = Node("#root", None, False, False)
    held, place = _Open(root), 0
    for m in _TOKEN.finditer(text):
        if m.start() > place:
            held.nodes[-1].children.append(text[place : m.start()])
        place = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.nodes[-1].children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m["tag2"] and not m[0].endswith(">"):
            break  # cut off within a tag
        tag, rest = tag.lower(), m["rest"] if m["tag"] else m["rest2"]
        if m["end"] or m["end2"]:
            held.close((tag,))
            continue
        if tag in ENDS_P:
            held.close(("p",), P_SCOPE)
        if tag in SIBLINGS:
            held.close(SIBLINGS[tag], SCOPE.get(tag, TABLE_SCOPE))
        at = held.nodes[-1]
        out, doubt = _outside(tag, rest, at.main)
        node = Node(tag, at, at.out or out, at.main or tag in MAIN, doubt)
        at.children.append(node)
        if tag not in VOID:  # HTML ignores a slash at the end of a tag
            held.push(node)
    if place < len(text) and not (text.find("<", place) >= 0 and re.match(r"<[a-zA-Z/]", text[text.find("<", place) :])):
        held.nodes[-1].children.append(text[place:])
    return root


def _measure(root: Node) -> list[Node]:
    """All nodes in page order, parents first, with their counts."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        for c in reversed(x.children):
            if isinstance(c, Node):
                todo.append(c)
            else:
                _count(x, c)
    for x in reversed(order):
        if (p := x.parent) is not None:
            _count(p, x)
            p.inline = p.inline and (x.inline or x.out)  # an inline element around a block is none
    return order


def _count(x: Node, part: Node | str) -> None:
    """Count a part among what a node holds."""
    if isinstance(part, Node):
        x.chars += part.chars
        x.tags += part.tags + (part.tag not in MATH)
        x.link_chars += part.link_chars
        x.link_tags += part.link_tags + part.linked
    else:
        n = _length(part)
        x.chars += n
        x.link_chars += n * x.linked


def _length(text: str) -> int:
    return len(text) - text.count(" ") if not text.isspace() else 0


def _density(x: Node, body: Node) -> float:
    c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, max(1, x.link_tags)
    if not c:
        return 0.0
    share = body.link_chars / body.chars if body.chars else 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    inner = c / max(1, lc) * t / lt
    return c / t * max(0.0, math.log(max(1.0, inner)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else math.log(max(1.0, inner)))


def _weigh(order: list[Node], body: Node) -> None:
    """Densities, and the sums of the children's, rounded once so that equal ones are equal."""
    for x in order:
        x.density = _density(x, body)
    for x in order:
        x.total = math.fsum(c.density for c in x.children if isinstance(c, Node) and not c.out)


def _inside(order: list[Node]) -> list[Node]:
    """The blocks that may be the text, parents first."""
    found = [x for x in order if not x.out and x.chars and not x.inline]
    return [x for x in found if x.tag not in ("html", "#root")] or found


def _weaken(order: list[Node], body: Node) -> bool:
    """Mark the subtrees whose class or id is evidence against them; whether there are any."""
    inside = _inside(order)
    if not inside or not any(x.doubt for x in order):
        return False
    lost: dict[int, int] = {}  # characters in what is out already
    for x in reversed(order):
        lost[id(x)] = x.chars if x.out else sum(lost[id(c)] for c in x.children if isinstance(c, Node))
    seen = {id(x): x.chars - lost[id(x)] for x in order}
    holds: set[int] = set()
    largest = 0
    for x in order:
        if x.tag in MAIN and not x.out and x.doubt < ALL and seen[id(x)] and x.link_chars < MOSTLY * x.chars:
            largest = max(largest, seen[id(x)])
            _mark_path(x, holds)
    summit: set[int] = set()
    _mark_path(max(inside, key=lambda x: x.total), summit)
    page = max(1, seen[id(body)])
    for x in order:
        if x.doubt and not x.out and id(x) not in holds:
            linked = x.link_chars >= (MOSTLY_IN_MAIN if x.main else MOSTLY) * x.chars
            if x.doubt == READERS:
                x.weak = seen[id(x)] < WHOLE * page
            elif id(x) not in summit:
                small = seen[id(x)] < SMALL * page or (not x.main and seen[id(x)] < BESIDE * largest)
                x.weak = linked or (x.doubt == ALL and small)
    return any(x.weak for x in order)


def _mark_path(x: Node | None, marked: set[int]) -> None:
    """Add a node and those above it."""
    while x is not None and id(x) not in marked:
        marked.add(id(x))
        x = x.parent


def _recount(order: list[Node]) -> None:
    """Link characters and link tags anew, with all of a weak subtree among them."""
    for x in order:
        x.weak = x.weak or (x.parent is not None and x.parent.weak)
        x.link_tags = 0
        x.link_chars = x.chars if x.weak else sum(_length(c) for c in x.children if isinstance(c, str)) * x.linked
    for x in reversed(order):
        if (p := x.parent) is not None:
            p.link_tags += x.link_tags + (x.linked or x.weak)
            p.link_chars += 0 if p.weak else x.link_chars


def main_parts(root: Node) -> list[Node]:
    """The parts of the page that are its main text, in page order; none lies in another."""
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    _weigh(order, body)
    if _weaken(order, body):
        _recount(order)
        _weigh(order, body)
    inside = _inside(order)
    if not inside:
        return []
    best = max(inside, key=lambda x: x.total)
    threshold, strict, x = best.density, best.density, best
    while x is not None and x is not body:
        strict, x = min(strict, x.density), x.parent
        threshold = min(strict, x.density) if x is not None else strict
    for x in order:
        x.out = x.out or (x.weak and x.density < threshold) or (x.parent is not None and x.parent.out)
    if all(x.out for x in inside):
        return []
    # Density sums within subtrees, the largest first seen from the leaves.
    top: dict[int, Node] = {}
    for x in reversed(order):
        if not x.out:
            top[id(x)] = max([x, *(top[id(c)] for c in x.children if isinstance(c, Node) and not c.out and not c.inline)], key=lambda y: y.total)
    main = _outermost_main(best)
    if best is body:
        _drop_link_lists(body)
    # Where an article or main element holds the text, the page's mean density says less about what lies outside it.
    return _pieces(body, main, top, threshold, threshold if main is None else strict) or [best]


def _drop_link_lists(page: Node) -> None:
    """Leave out the lists of links that a page which is all one piece begins with: references follow their text."""
    for c in page.children:
        if not isinstance(c, Node):
            if not c.isspace():
                return
        elif not c.out and c.chars:
            if c.inline or c.link_tags < LINKS or c.link_chars < LINK_SHARE * c.chars:
                return
            c.out = True


def _pieces(body: Node, main: Node | None, top: dict[int, Node], threshold: float, beside: float) -> list[Node]:
    """In page order: main; the largest sums within the nodes at or above the threshold; loose text at or above it.

    The threshold is that in article or main elements, elsewhere beside holds.
    """
    pieces: list[Node] = []
    marked = {id(main)} if main is not None else set()
    todo = [body]
    while todo:
        x = todo.pop()
        if x.out or not x.chars:
            continue
        dense = x.density >= (threshold if x.main else beside)
        if dense and x.tag != "#loose" and id(x) not in marked:
            marked.add(id(top[id(x)]))
        if id(x) in marked or (dense and x.tag == "#loose"):
            pieces.append(x)
        elif x.tag != "#loose":
            todo += reversed(_parts(x, body))
    return pieces


def _parts(x: Node, body: Node) -> list[Node]:
    """The blocks among a node's children, and each run of text and inline elements between them as a node of its own."""
    parts: list[Node] = []
    loose: Node | None = None
    for c in x.children:
        if isinstance(c, Node) and c.out:
            continue
        if isinstance(c, Node) and not c.inline:
            parts.append(c)
            loose = None
            continue
        if loose is None:
            parts.append(loose := Node("#loose", x, False, x.main))
        loose.children.append(c)
        _count(loose, c)
    for part in parts:
        if part.tag == "#loose":
            part.density = _density(part, body)
    return parts


def _outermost_main(x: Node | None) -> Node | None:
    """The article or main element around a node that is in no other, or None."""
    found = None
    while x is not None:
        if x.tag in MAIN:
            found = x
        x = x.parent
    return found


def blocks(parts: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(text)
            held.clear()

    todo: list[Node | str | None] = list(reversed(parts))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(html.unescape(x) if "&" in x else x)
        elif x.tag == "br":
            held.append(" ")
        elif not x.out:
            if x.tag not in INLINE and x.tag not in MATH:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(blocks(main_parts(parse(page))))


@tidied
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = pa.array([main_text(x.as_py()) for x in b.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), text], ["id", "url", "text"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id, url, text."""
    rows = packed(df, id=id_col, url=url_col, html=html_col).select("id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extracted, f"id {kinds['id']}, url {kinds['url']}, text string")
