"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul head".split()
)
#: Elements that never hold article text.
NEVER = frozenset("head script style noscript template iframe svg canvas object audio video form button select textarea nav footer aside menu dialog search".split())
CLOSES_P = BLOCK - frozenset("html body head li dt dd option optgroup td th tr tbody thead tfoot caption legend figcaption summary".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: An open paragraph is closed by a block start only within these, and by its end tag only within the second.
P_SCOPE = ("table", "article", "main", "div", "section", "td")
END_SCOPE = ("table", "article", "main")
#: Elements whose own text counts as one paragraph of the container they are in.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption details summary address caption tr tbody thead tfoot table ul ol dl center legend fieldset".split())
#: Words of class names and ids that mark what is seldom the article.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login form search searchbox comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "pagination pager toolbar topbar outbrain taboola copyright disclaimer teaser teasers".split()
)
#: Words that say where a block is or how it is built, and nothing of what is in it.
NEUTRAL_WORDS = frozenset(
    "area right left top bottom container wrapper wrap inner outer box bar block list item items section panel content site page global primary secondary tools button "
    "buttons link links post posts reader user thread group module slot unit units entry row col column sub small large inline mobile desktop responsive sticky floating "
    "fixed mid middle center wide full native card cards grid feed holder placeholder frame zone region count message messages field fields title text label icon icons view".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
SIDE_ARTICLE = frozenset("comment comments reply replies ad advert promo sponsored related teaser".split())
SIDE_PARTS = frozenset("reader user item entry box list thread wrapper block post".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
#: Words of an inline element that make its text no part of the sentence around it.
SIDE_INLINE = frozenset("ad ads advert advertisement sponsored promo share sharing".split())
#: Points of a block are multiplied by this when its name says only side words, or side words among others.
ONLY_SIDE, PARTLY_SIDE = 0.01, 0.5
#: A sibling, or a block within the best container, needs this share of the best container's points.
SIBLING_SHARE = 0.2

_TAG = re.compile(
    r"<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/?(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>|[!?/][^>]*+>)"
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>\"']|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element; items are its text runs and child blocks in page order."""

    __slots__ = ("tag", "parent", "items", "drop", "factor", "main", "depth", "own", "points", "score", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, drop: bool, factor: float, main: bool):
        self.tag, self.parent, self.drop, self.factor, self.main = tag, parent, drop, factor, main
        self.depth = 0 if parent is None else parent.depth + 1
        self.items: list = []
        self.own = self.points = self.score = 0.0
        self.chars = self.link_chars = 0

    def density(self) -> float:
        return self.link_chars / max(1, self.chars)


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _factor(name: str, tag: str, in_main: bool) -> float:
    """What a class name or id makes of a block's points."""
    words = [w for w in _words(name) if not w.isdigit()]
    if not words or words[0] in ("with", "has", "no", "without", "js"):
        return 1.0
    if "header" in (words[0], words[-1]) and (in_main or words[0] in MAIN_WORDS - {"main"}):
        return 1.0
    if tag == "article":  # articles carry many classes; only a plain name says that it is a comment or a teaser
        return ONLY_SIDE if set(words) & SIDE_ARTICLE and set(words) <= SIDE_ARTICLE | SIDE_PARTS else 1.0
    if words[0] not in SIDE_WORDS and words[-1] not in SIDE_WORDS:
        return 1.0
    return ONLY_SIDE if set(words) <= SIDE_WORDS | NEUTRAL_WORDS else PARTLY_SIDE


def _judge(tag: str, attrs: str, in_main: bool) -> tuple[bool, float, bool]:
    """Whether an element with these attributes is left out for what it is, the factor of its points, and
    whether it is a main element."""
    if tag in NEVER or tag == "header" and not in_main:
        return True, 0.0, False
    main, factor = tag in ("article", "main"), 1.0
    if not attrs or attrs.isspace():
        return False, factor, main
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, 0.0, False
        if key == "role":
            if value.lower() in SIDE_ROLES:
                return True, 0.0, False
            main = main or value.lower() in ("main", "article")
        elif key in ("class", "id") and tag not in ("html", "body", "main"):
            factor = min([factor, *(_factor(name, tag, in_main) for name in value.split())])
    return False, factor, main


def _leaves_sentence(tag: str, attrs: str) -> bool:
    """Whether the text of an inline element is no part of the sentence around it."""
    if tag in NEVER:
        return True
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key == "role" and value.lower() in SIDE_ROLES or key == "class" and any(n.lower() in SIDE_INLINE for n in value.split()):
            return True
    return False


class _Open:
    """The open elements, innermost last, with the depths at which each tag is open: what an end tag closes is
    found without a walk over the ancestors."""

    def __init__(self, top: Node):
        self.path = [top]
        self.at: dict[str, list[Node]] = {top.tag: [top]}

    def push(self, node: Node) -> None:
        self.path.append(node)
        self.at.setdefault(node.tag, []).append(node)

    def innermost(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> Node | None:
        """The innermost open element of these tags that no element of scope is within."""
        found, depth = None, -1
        for t in tags:
            stack = self.at.get(t)
            if stack and stack[-1].depth > depth:
                found, depth = stack[-1], stack[-1].depth
        if found is not None:
            for t in scope:
                stack = self.at.get(t)
                if stack and stack[-1].depth > depth:
                    return None
        return found

    def close(self, node: Node) -> Node:
        """Closes node and all within it; gives its parent."""
        while True:
            last = self.path.pop()
            self.at[last.tag].pop()
            if last is node:
                return self.path[-1]


def tree(html: str) -> Node:
    """The blocks of a page, in time that grows with its length whatever it holds. End tags that match
    nothing are passed over; missing ones are implied."""
    top = Node("html", None, False, 1.0, False)
    node, links, dropped = top, 0, 0
    opened = _Open(top)
    inline: list[str] = []  # elements inside a block that have to be left out
    inside: Counter[str] = Counter()  # how many of each
    at, size = 0, len(html)
    last_end = html.rfind(">")  # a tag that starts beyond it never ends
    search = _TAG.search

    def text(run: str) -> None:
        if run and not node.drop and not dropped:
            if node.items and type(node.items[-1]) is list:
                node.items[-1].append(run)
            else:
                node.items.append([run])
            n = len(run)
            node.chars += n
            if links:
                node.link_chars += n

    def leave(closed: Node) -> None:
        nonlocal node, links, dropped
        node, links, dropped = opened.close(closed), 0, 0
        inline.clear()
        inside.clear()

    while at < size:
        m = search(html, at, last_end + 1) if at <= last_end else None
        if m is None:
            rest = html.find("<!--", at)
            text(html[at : size if rest < 0 else rest])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        comment, slash, name, attrs, loose, rest = m.groups()
        if comment is not None:
            end = html.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        name = name or loose
        if name is None:
            continue
        tag, attrs = name.lower(), attrs or rest or ""
        if slash or loose and html[m.start() + 1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                found = opened.innermost((tag,), END_SCOPE if tag in ("p", "li") else ())
                if found is not None and found is not top:
                    leave(found)
            elif inside[tag]:
                while True:
                    last = inline.pop()
                    inside[last] -= 1
                    if last == tag:
                        break
                dropped = len(inline)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            if end is None:
                at = size
            else:
                close = html.find(">", end.end())
                at = size if close < 0 else close + 1
            continue
        if attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag not in BLOCK:
            if tag == "a":
                links += 1
            elif _leaves_sentence(tag, attrs) or inline and tag == inline[-1]:
                inline.append(tag)
                inside[tag] += 1
                dropped = len(inline)
            continue
        if opened.at.get("p") and tag in CLOSES_P and (found := opened.innermost(("p",), P_SCOPE)) is not None:
            leave(found)
        if tag in SELF_CLOSING and (found := opened.innermost(SELF_CLOSING[tag], SCOPE[tag])) is not None:
            leave(found)
        if tag == "hr":
            node.items.append(Node("hr", node, True, 0.0, False))
            continue
        if tag in ("html", "body") and node.tag in ("html", "body"):
            if tag == "body" and node.tag == "html":
                child = Node("body", node, False, 1.0, False)
                node.items.append(child)
                node = child
                opened.push(child)
            continue
        drop, factor, main = _judge(tag, attrs, node.main)
        child = Node(tag, node, node.drop or bool(dropped) or drop, factor, node.main or main)
        node.items.append(child)
        node = child
        opened.push(child)
    return top


def _stays(node: Node, least: float) -> bool:
    """Whether a block within the best container is article text: a plain one unless it is a container of links
    outside any main element, one whose name also says something else unless a third of it is links, one whose name says only that it is not, if its discounted points reach `least`."""
    if node.factor > ONLY_SIDE:
        return node.density() < (0.33 if node.factor <= PARTLY_SIDE else 0.8 if node.tag not in PARAGRAPHS | {"article"} and not node.main else 1.1)
    return node.factor * node.points * (1 - node.density()) >= least


def _runs(node: Node, least: float) -> Iterator[str]:
    """Text runs below a node in page order, of blocks that stay."""
    stack: list[Iterator] = [iter(node.items)]
    while stack:
        for item in stack[-1]:
            if type(item) is list:
                run = "".join(item)
                if run := " ".join((unescape(run) if "&" in run else run).split()):
                    yield run
            elif not item.drop and _stays(item, least):
                stack.append(iter(item.items))
                break
        else:
            stack.pop()


def _walk(top: Node) -> list[Node]:
    """All nodes that are kept, parents before children."""
    out = [top]
    for node in out:
        out.extend(x for x in node.items if type(x) is Node and not x.drop)
    return out


def _give_points(nodes: list[Node]) -> None:
    """Every run of text in a block is a paragraph: a point for each comma, and one for each 100 characters, up to 3. A
    paragraph's points go whole to its container, half to the one above, a quarter to the next, and so on to
    the top (`score`); `points` is the undivided sum. A block whose name says that it is
    beside the article passes on only its factor of them."""
    for node in nodes:
        for run in node.items:
            if type(run) is list and any(not part.isspace() for part in run):
                node.own += sum(part.count(",") for part in run) + min(sum(map(len, run)) / 100, 3)
    for node in reversed(nodes):
        node.points += node.own
        node.score += node.own
        up = node.parent
        if up is not None:
            up.points += node.points * node.factor
            up.score += node.score * node.factor * (1 if node.tag in PARAGRAPHS else 0.5)
            up.chars += node.chars
            up.link_chars += node.link_chars


def _container_score(node: Node, shrink: float) -> float:
    if node.tag in PARAGRAPHS:
        return 0.0
    found = (2 * node.points + 25 if node.tag in ("article", "main") and node.points > 0 else node.score) * (1 - node.density())
    return found * shrink


def extract(html: str | None) -> str:
    """The article of a page: blocks in page order, one space between them.

    Every paragraph passes points for its length and commas to its ancestors, without end but halved at each
    step; each container's points are discounted by the share of its text in links, and an article or main
    element gets the undivided sum twice, and 25 more. Names of classes that speak of menus, adverts, notices, comments and the like
    only discount: to a hundredth where the name says nothing else, to half where it does.
    The best container is kept, or the one article within it that has most of its points; with it come
    those siblings that have a fifth of its discounted points, and headings and paragraphs beside a plain container.
    Within it a block whose name says only side words stays if its discounted points reach those of all the
    rest, one whose name says more if less than a third of it is links; outside article and main elements
    containers that are links for four fifths go too. Elements that are never article
    text (nav, footer, aside, form, script and so on), hidden parts and their like by role never take part.
    Null, an empty page, or one without text gives the empty text; a page of any length takes time in
    proportion to it.
    """
    if not html:
        return ""
    top = tree(html)
    nodes = _walk(top)
    _give_points(nodes)
    shrink = {id(top): 1.0}
    scores: dict[int, float] = {}
    best, most = None, 0.0
    for node in nodes:
        if node.parent is not None:
            shrink[id(node)] = shrink[id(node.parent)] * node.factor
        scores[id(node)] = found = _container_score(node, shrink[id(node)])
        if found > most:
            best, most = node, found
    if best is None:
        return ""
    # main holds all articles of a page: one that has most of its points is the article.
    inner = [n for n in nodes if n.tag == "article" and n is not best and 2 * n.points > best.points] if best.tag == "main" else []
    if inner and (nearest := max(inner, key=lambda n: scores[id(n)])).score > 0:
        best, most = nearest, scores[id(nearest)]
    least = max(1.0, best.points)
    if best.parent is None:
        return " ".join(_runs(best, least))
    blocks: list[str] = []
    for item in best.parent.items:
        if item is best:
            blocks += _runs(best, least)
        elif type(item) is Node and not item.drop and _keeps(item, best):
            blocks += _runs(item, least)
    return " ".join(blocks)


def _keeps(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    if node.density() >= 0.33 or node.factor <= ONLY_SIDE:
        return False
    if best.tag in ("article", "main"):
        if node.tag != best.tag:
            return False
    elif node.tag in ("h1", "h2"):
        return True
    elif node.tag in ("p", "blockquote", "pre", "figure"):
        return node.density() < 0.25
    return node.tag not in PARAGRAPHS and node.factor * node.points * (1 - node.density()) >= SIBLING_SHARE * best.points * (1 - best.density())


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and text, the main text of the whole html of each row, however long; repeated rows
    are each extracted, and an empty table gives no rows. Columns in keep may have any names but text."""
    mine = common.free_names(pages.select(*keep), "_html")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h.as_py()) for h in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], "text"])

    return pages.select(F.col("html").cast("string").alias(mine), *keep).mapInArrow(run, pages.select(*keep).schema.add("text", "string"))
