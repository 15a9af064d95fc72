"""HTML extraction by tree scoring: paragraphs pass points up, link density discounts them, the best container wins."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import prepare

#: The name of a tag after its ``<``, what may end a tag, and its attributes.
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or not text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside button select option textarea iframe "
    "object svg canvas audio video dialog menu noembed noframes input".split()
)
ARTICLES, FORMS = ("article", "main"), ("form", "fieldset")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are cut unless they wrap most of the page's text, as forms of some page frameworks do.
WRAPPERS = frozenset(FORMS)
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hr details summary header footer nav aside form fieldset center".split()
)
#: A start tag of the key closes open elements of these names first (HTML's implied end tags).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
#: What stops such a search.
SCOPES = frozenset("ul ol dl table select article section main div body html".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
#: Class, id or role words of parts that are no article: menus, sidebars, notices, adverts, comments and the like.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|cookies?|consent|contentinfo|dialog|disclaimer|"
    r"disqus|footer|foot|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notices?|alert|pager|pagination|popup|"
    r"promo\w*|related|recommend\w*|replies|respond|rss|search|share|sharing|sidebar|side|signup|skyscraper|social|"
    r"sponsor\w*|subscribe|subscription|tags|toolbar|widget|complementary|navigation|discussion)(?:$|[\s_-])",
    re.I,
)
#: Words that say nothing about a paragraph that has them: these cut larger parts only.
WEAK = frozenset("side search share sharing related rss tags header foot alert dialog disclaimer contentinfo widget complementary discussion".split())
CONTAINERS = frozenset("div section ul ol dl table tbody tr figure details nav aside header footer form fieldset center".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
#: Names that tell how a page looks, not what an element is.
MODIFIER = re.compile(r"(?:has|no|with|without|is|not|hide|show|fixed|sticky|enable|disable)[_-]", re.I)
SPACES = re.compile(r"\s+")
#: What ends a sentence, with the marks that may close it.
ENDINGS = frozenset(".!?…:;\"'”’»)")
#: Characters below which a paragraph gives no points; a comma gives one, 100 characters give one, three at most.
LEAST_CHARS, CHARS_A_POINT, MOST_LENGTH_POINTS = 25, 100, 3
#: Characters of a part with a doubtful name from which it may be a sentence of the article.
LEAST_SENTENCE = 20
#: Share of linked text from which a part between two parts of the article is a list of links; a paragraph's.
MOSTLY_LINKS, ONLY_LINKS = 0.5, 0.9
#: Share of the best container's score that a sibling needs, and its floor.
SIBLING_SHARE, SIBLING_FLOOR = 0.2, 10.0


class Node:
    """An element with its children (elements and strings) in page order, the points it has been passed, and the
    measures of its text: characters and commas of its inline text, characters of all and of linked text below, the
    last character, whether a block is below."""

    __slots__ = ("tag", "parent", "children", "score", "dropped", "doubtful", "weight", "own", "commas", "chars", "linked", "last", "blocky", "around", "weak", "leading")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children, self.score = tag, parent, [], 0.0
        named = {k.lower(): b or c or d for k, b, c, d in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}
        names = " ".join(filter(None, (named.get(k) for k in ("class", "id", "role"))))
        likely = bool(names and LIKELY.search(names))
        self.around = parent.around if parent else 0  # 1 inside an article, 2 inside a form
        if parent is not None and parent.tag in ARTICLES + FORMS:
            self.around |= 1 if parent.tag in ARTICLES else 2
        unlikely, strongly = bool(names and UNLIKELY.search(names)) and tag not in ("html", "body", "article", "main"), False
        if unlikely:  # told by each name's last word of either sort; one likely name spares the element
            sorts = {sort(x, tag in CONTAINERS) for x in names.split()}
            likely, unlikely = likely and 1 not in sorts, 1 in sorts and 2 not in sorts
            strongly = unlikely and 1 in {sort(x, False) for x in names.split()}
        hidden = bool(named) and ("hidden" in named or named.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", named.get("style") or "")))
        self.dropped = tag in DROPPED or hidden or tag == "label" and bool(self.around & 2)
        self.doubtful = (unlikely or tag in WRAPPERS) and not self.dropped  # cut by its name alone
        self.weak = self.doubtful and not strongly and bool(self.around & 1) and tag not in WRAPPERS  # a name that parts of articles have, too
        self.leading = tag == "header" and bool(self.around & 1) and not hidden and not strongly
        self.dropped |= self.doubtful
        self.weight = (25.0 if likely else 0.0) + {"article": 30.0, "main": 20.0}.get(tag, 0.0)


def sort(name: str, container: bool = True) -> int:
    """1 for an unlikely class, id or role, 2 for a likely one, else 0: ``post-comments`` are comments, ``side-content``
    is content, ``has-sidebar`` says nothing, nor does ``share`` of a paragraph."""
    if MODIFIER.match(name):
        return 0
    for word in reversed(re.split(r"[_-]+", name)):
        if UNLIKELY.search(word) and (container or word.lower() not in WEAK):
            return 1
        if LIKELY.search(word):
            return 2
    return 1 if container and UNLIKELY.search(name) else 0


def tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag; quoted attribute values may hold others. -1 where a quote or the tag is open
    to the end of the page."""
    while m := STOP.search(page, at):
        i = j = m.start()
        if m[0] == ">":
            return i
        while page[j - 1].isspace():
            j -= 1
        at = i + 1
        if page[j - 1] == "=":
            if (close := page.find(m[0], at)) < 0:
                return -1
            at = close + 1
    return -1


class Tree:
    """Open elements of a page that is being read. Counts by name tell beforehand whether an end tag finds its start, so
    that each walk up the tree closes what it passes, and reading is linear in the page."""

    def __init__(self) -> None:
        self.root = self.here = Node("#root", None)
        #: Open elements of each name: in all, and since each open element that is in SCOPES.
        self.open: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]

    def enter(self, node: Node) -> None:
        self.here = node
        self.open[node.tag] += 1
        if node.tag in SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][node.tag] += 1

    def leave(self) -> None:
        tag = self.here.tag
        self.open[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        self.here = self.here.parent

    def close(self, names: tuple[str, ...]) -> None:
        """Close all open elements of these names since the last scope, and what is in them."""
        left = sum(self.scopes[-1][x] for x in names)
        while left:
            left -= self.here.tag in names
            self.leave()

    def end(self, tag: str) -> None:
        """An end tag closes up to its start tag, or nothing; that of an inline element not beyond its block."""
        if self.open[tag] and (tag in BLOCKS or self.scopes[-1][tag]):
            while self.here.tag != tag:
                self.leave()
            self.leave()


def parse(page: str) -> Node:
    """A tree of the page, read once from left to right. Tags are paired leniently."""
    tree, at, n, quoted = Tree(), 0, len(page), True
    while at < n:
        start = page.find("<", at)
        sign = page[start + 1 : start + 2] if start >= 0 else ""
        if not sign or not (sign in "!?/" or "a" <= sign.lower() <= "z"):  # plain text, or a plain less-than sign
            end = n if start < 0 else start + 1
            tree.here.children.append(page[at:end])
            at = end
            continue
        if start > at:
            tree.here.children.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else n
            continue
        name = NAME.match(page, start + 1)
        end = tag_end(page, start + 1) if name and quoted else page.find(">", start)
        if end < 0 and name and quoted:  # from a quote that never ends on, quotes mean nothing
            quoted, end = False, page.find(">", start)
        if end < 0:  # text, but for a tag cut off at the end of the page
            tree.here.children.append(page[start : page.rfind("<")])
            break
        at = end + 1
        if not name:
            continue
        tag, attributes = name[0].lower(), page[name.end() : end]
        if tag[0] == "/":
            tree.end(tag[1:])
            continue
        if tag in BLOCKS:
            tree.close(("p",))
        if tag in CLOSES:
            tree.close(CLOSES[tag])
        node = Node(tag, tree.here, attributes)
        tree.here.children.append(node)
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : raw.start() if raw else n])
            at = raw.end() if raw else n
        elif tag not in VOID and not attributes.endswith("/"):
            tree.enter(node)
    return tree.root


def clean(text: str) -> str:
    return SPACES.sub(" ", html.unescape(text)).strip()


def blocks(node: Node) -> list[str]:
    """The node's text as blocks in page order: block elements and line breaks end a block."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := clean("".join(line)):
                out.append(text)
            line.clear()

    stack: list[tuple[Node, Iterator]] = [(node, iter(node.children))]
    while stack:
        top, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if top.tag in BLOCKS:
                flush()
        elif isinstance(child, str):
            line.append(child)
        elif child.dropped:
            if child.tag in BLOCKS:
                flush()
        elif child.tag == "br":
            flush()
        else:
            if child.tag in BLOCKS:
                flush()
            stack.append((child, iter(child.children)))
    flush()
    return out


def measure(root: Node) -> list[Node]:
    """Kept elements in page order, with their measures."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    for node in reversed(order):
        node.own = node.commas = node.chars = node.linked = 0
        node.last, node.blocky = "", False
        for c in node.children:
            if isinstance(c, str):
                text = clean(c)
                if text:
                    node.own += len(text) + (node.own > 0)
                    node.commas += text.count(",")
                    node.chars += len(text)
                    node.last = text[-1]
            elif not c.dropped:
                node.chars += c.chars
                node.linked += c.chars if c.tag == "a" else c.linked
                node.last = c.last or node.last
                block = c.tag in BLOCKS
                node.blocky |= block or c.blocky
                if not block and c.own:
                    node.own += c.own + (node.own > 0)
                    node.commas += c.commas
    return order


def spare(root: Node) -> None:
    """Keep elements cut by name alone that hold most of the page's text of some length, unless other text is in an
    element that is named or tagged as the article (say, a short article with many reader comments). Parts of an article
    with names like related or dialog stay if they read like text: sentences, with few links."""
    order: list[tuple[Node, bool]] = []
    stack, doubt = [(root, False)], False
    while stack:
        node, below = stack.pop()
        below |= node.doubtful
        doubt |= below
        order.append((node, below))
        stack.extend((c, below) for c in node.children if isinstance(c, Node) and (c.doubtful or not c.dropped))
    if not doubt:
        return
    chars: dict[int, int] = {}
    every: dict[int, tuple[int, int, str]] = {}  # characters, those in links, the last one
    some: set[int] = set()  # elements with any text
    for node, _ in reversed(order):
        if any(c.strip() if isinstance(c, str) else id(c) in some for c in node.children):
            some.add(id(node))
        total, linked, last = 0, 0, ""
        for c in node.children:
            if isinstance(c, str):
                n, in_links, end = len(c.strip()), 0, c.strip()[-1:]
            else:
                n, in_links, end = every.get(id(c), (0, 0, ""))
            total, linked, last = total + n, linked + in_links, end or last
        every[id(node)] = total, total if node.tag == "a" else linked, last
        own = sum(len(c) for c in node.children if isinstance(c, str) and len(c.strip()) >= LEAST_CHARS)
        chars[id(node)] = 0 if node.tag == "a" else own + sum(chars.get(id(c), 0) for c in node.children if isinstance(c, Node))
    marked = {id(n) for n, below in order if n.weight and not below and id(n) in some and n.tag not in ("html", "body")}
    around = {id(root): 0}
    for node, _ in order[1:]:
        around[id(node)] = around[id(node.parent)] + (id(node.parent) in marked)
        if node.doubtful and 2 * chars[id(node)] > chars[id(root)] and around[id(node)] == len(marked):
            node.dropped = False
        total, linked, last = every[id(node)]
        if node.weak and total >= LEAST_SENTENCE and 4 * linked < total and last in ENDINGS:
            node.dropped = False


def lead(root: Node) -> None:
    """Keep the header that an article begins with: it holds the title."""
    stack = [root]
    while stack:
        node = stack.pop()
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
        if node.tag not in ARTICLES:
            continue
        walk = [iter(node.children)]
        while walk:  # the first text in page order
            child = next(walk[-1], None)
            if child is None:
                walk.pop()
            elif isinstance(child, str):
                if child.strip():
                    break
            elif child.leading:
                child.dropped = False
                break
            elif child.tag in ARTICLES:
                break  # has a beginning of its own
            elif not child.dropped:
                walk.append(iter(child.children))


def leaf(node: Node) -> bool:
    """A div that is a paragraph itself: no block inside but dropped ones."""
    return node.tag == "div" and not node.blocky


def main_nodes(root: Node) -> list[Node]:
    """The best container with those of its siblings that belong to the article, in one frame."""
    order = measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag not in PARAGRAPHS or node.own < LEAST_CHARS:
            continue
        points = 1.0 + node.commas + min(node.own // CHARS_A_POINT, MOST_LENGTH_POINTS)
        # the whole to the parent (or itself, for text directly in a container), half to its parent, then thirds; a div
        # that is a paragraph gives the whole to both
        around = leaf(node)
        ancestor, level = (node.parent if node.tag in ("p", "pre", "td", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6") else node), 0
        while ancestor is not None and ancestor is not root and level < 5:
            if id(ancestor) not in scored:
                scored[id(ancestor)] = ancestor
                ancestor.score += ancestor.weight
            ancestor.score += points / ((1, 1, 2, 6, 9) if around else (1, 2, 6, 9, 12))[level]
            ancestor, level = ancestor.parent, level + 1
    if not scored:
        return []

    def density(node: Node) -> float:
        return node.linked / node.chars if node.chars else 0.0

    def final(node: Node) -> float:
        return node.score * (1 - density(node))

    best = max(scored.values(), key=final)  # ties: the first that was scored, in page order
    # paragraphs under inline wrappers (say <b> that was never closed) belong to the block around them
    while best.tag not in BLOCKS and best.parent is not None and best.parent is not root:
        best = best.parent
    # an article around the best container is the article
    up = best.parent
    while up is not None and up is not root:
        if up.tag in ("article", "main") and density(up) < 0.5:
            best = up
        up = up.parent
    threshold = max(SIBLING_FLOOR, final(best) * SIBLING_SHARE)
    while best.parent is not None and best.parent.parent is not None and best.parent.tag not in ("body", "html") and best.parent.chars == best.chars:
        best = best.parent  # a frame around it without text of its own
    if best.parent is None or best.tag in ("body", "html"):
        return [best]

    def belongs(node: Node | str) -> bool:
        if isinstance(node, str) or node.dropped:
            return False
        good = node is best or id(node) in scored and final(node) >= threshold
        plain = node.tag in ("div", "section") and not node.doubtful and (id(node) in scored or leaf(node))
        if plain or node.tag in ("p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"):
            good |= node.chars > 80 and density(node) < 0.25 or node.chars > 0 and density(node) == 0 and node.last in ENDINGS
        return good

    children = best.parent.children
    kept = [belongs(c) for c in children]
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    for i in range(first, last):  # nothing between two parts of the article is lost but what is cut, and links
        c = children[i]
        kept[i] = kept[i] or isinstance(c, str) or not c.dropped and (1.0 if c.tag == "a" else density(c)) < (ONLY_LINKS if c.tag == "p" else MOSTLY_LINKS)
    for i in range(first - 1, -1, -1):  # headings go with what follows them
        c = children[i]
        if not isinstance(c, str) and not c.dropped and c.chars:
            if c.tag not in HEADINGS or density(c) >= MOSTLY_LINKS:
                break
            kept[i] = True
        elif isinstance(c, str) and c.strip():
            break
    frame = Node("div", None)
    frame.children = [c for c, k in zip(children, kept) if k]
    return [frame]


def main_text(page: str | None) -> str:
    """The main text of one page; '' where nothing is a paragraph of some length and nothing is left of the body."""
    root = parse(page or "")
    spare(root)
    lead(root)
    nodes = main_nodes(root)
    if not nodes:  # a page of short lines only: what remains of it when boilerplate is gone
        nodes = [root]
    return "\n".join(line for node in nodes for line in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``: the article's blocks in page order.

    Paragraphs give points for length and commas to their ancestors, less with each level; a container's points are
    discounted by its share of linked text; the best one and siblings that score enough or read like text are kept, with
    headings before them and all between them that isn't cut or mostly links.
    Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments are cut out of the
    tree first, by element and by class, id or role; a likely name beside an unlikely one spares an element, and so does
    most of the page's text (also that of a form around the page). Inside an article its leading header stays, and so do
    parts that are named like related things but read like text. Character references are decoded, white space inside a block
    becomes one space, and blocks are joined by a newline.

    Defined cases: null or empty html gives an empty text; unclosed and crossing tags are paired leniently; a page
    without any longer paragraph gives what is left of its body; repeated rows are extracted alike; other columns are
    ignored; an empty table gives an empty result. Whole pages are read, of any length.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
