"""Main text of HTML pages by tree scoring.

A page becomes a tree (tags closed as browsers would, enough for scoring).  Parts that are never
article text go first: by tag, by role, when hidden, or by a word of their class or id.  Every block with
text of its own is a paragraph: one point, one for each comma, one for each 100 characters up to three.
It passes its points to its parent, half to the grandparent, a third, a fourth to the next two; a
container's points are discounted by its link density.  The best container is kept, with its siblings
that score a fifth of it or, whatever their score, are text, headings, paragraphs, lists or tables with few
links, or boxes of such; if it lies in an ``article`` (else a ``main``) element, that element is the article.
Link lists inside go, but for those that a heading or a line ending in a colon introduces (references); an
introduction with a word of the list ("Related") goes with its links.  Each block's white space becomes one
space; blocks join in page order by one space; character references are decoded.

A word of the list marks boxes.  Paragraphs, headings and inline text marked by a word that is also a topic
or a style (``<p class="social">``) go only if they are mostly links.  Of several articles on a page the one
of the best container is the page's text, and a ``header`` element goes wherever it stands.

Pages are worked on one by one in Arrow batches, with no shuffle.  Defined results: null or empty html,
and pages without text outside the dropped parts, give an empty text; repeated rows agree.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
DROPPED = frozenset(
    "head script style textarea title noscript iframe xmp noframes nav header footer aside form button select option "
    "svg canvas object template dialog menu audio video map".split())
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li main ol p "
    "pre section summary table tbody td tfoot th thead tr ul br".split()) | (DROPPED - {"button", "svg", "canvas", "object", "select", "option"})
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl select html body article section div main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tooltip status".split())
#: A class or id with one of these words (whole words, cut at anything but letters and at small-to-capital).
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies discussion discussions disqus disclaimer footer footers gdpr header masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended recommendations related "
    "replies reply respond rss share sharing shares shoutbox sidebar sidebars signup skyscraper social sponsor sponsored subscribe "
    "subscription tags toc toolbar topbar trending widget widgets".split())
#: Of these, words that also name a topic or a style: not enough to drop a paragraph, heading or inline text.
_TOPICS = frozenset(
    "banner banners discussion discussions disclaimer header masthead menu menus navigation notification overlay promotion recommended "
    "related replies reply respond rss share sharing shares social sponsor subscription tags toc trending".split())
_RUNNING = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 a abbr b cite code em font i mark q s small span strong sub sup time tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption".split())
_BOXES = frozenset("ul ol dl div section table details".split())
#: Beside the best container these stay whatever their score, unless they are mostly links.
_CONTENT = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table".split())
#: A sibling of another kind that holds one of these is content, too.
_HOLDS = frozenset("p pre blockquote ul ol dl table".split())
_KEPT = frozenset("html body article main".split())
#: Start tags that don't end an open head.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "link", "points", "unwanted", "doubtful")

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.children, self.points = tag, parent, [], 0.0
        self.unwanted, self.doubtful = unwanted, doubtful
        self.link = tag == "a" or parent is not None and parent.link


def _listed(text: str) -> frozenset:
    """The words of the list in a class, an id or a heading."""
    return UNLIKELY.intersection(_WORDS.findall(_HUMP.sub(" ", text).lower()))


def _marked(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is unwanted, and whether it is doubtful: unwanted if mostly links."""
    if tag in DROPPED:
        return True, False
    if not attrs or attrs.isspace() or tag in _KEPT:
        return False, False
    doubtful = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.strip().lower() in ROLES:
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name in ("class", "id"):
            words = _listed(value)
            if words and not (tag in _RUNNING and words <= _TOPICS):
                return True, False
            doubtful = doubtful or bool(words)
    return False, doubtful


def _end_of(now: Node, root: Node, tag: str) -> Node | None:
    """The open element that an end tag closes; nothing outside its container, but for unwanted elements."""
    node, inside = now, True
    while node is not root:
        if node.tag == tag and (inside or node.unwanted):
            return node
        inside &= tag in _SCOPE or node.tag not in _SCOPE
        node = node.parent
    return None


def tree(page: str) -> Node:
    """The page's tree.  Unwanted elements are opened and closed as others, but no parent lists them."""
    root = Node("html", None)
    now, at = root, 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            text = html.unescape(m["text"]) if m["text"] is not None else m["cdata"]
            if now.tag == "head" and not text.isspace():
                now = now.parent
            now.children.append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if closing:
            node = _end_of(now, root, tag)
            if node is not None:
                now = node.parent
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if now.tag == "head" and tag not in _HEAD:
            now = now.parent
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and tag != "br":
            node = now  # a block ends open paragraphs and headings of the same container
            while node is not root and node.tag not in _SCOPE:
                if node.tag == "p" or tag in ENDS and node.tag in ENDS[tag]:
                    now = node.parent
                node = node.parent
        elif tag in ENDS and now.tag in ENDS[tag]:
            now = now.parent
        unwanted, doubtful = _marked(tag, attrs)
        if tag not in VOID and unwanted:
            if not attrs.rstrip().endswith("/"):
                now = Node(tag, now, True)
            continue
        child = Node(tag, now, doubtful=doubtful)
        now.children.append(child)
        if tag not in VOID:
            now = child
    return root


def blocks(node: Node, out: list[str] | None = None, own: list | None = None) -> list[str]:
    """The texts of the blocks under a node, in page order (raw, before white space is settled).

    ``own`` gets ``(block node, text, linked characters)`` of each."""
    out = [] if out is None else out
    open_text: list[str] = []
    linked = 0
    holder = node

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(open_text).split())
        if text:
            out.append(text)
            if own is not None:
                own.append((holder, text, linked))
        open_text.clear()
        linked = 0

    stack = [(node, iter(node.children), holder)]
    while stack:
        here, children, owner = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if here.tag in BLOCKS:
                holder = owner if owner is here else here
                close()
                holder = stack[-1][2] if stack else node
            continue
        if isinstance(child, str):
            holder = owner
            open_text.append(child)
            if here.link:
                linked += len(child)
        elif child.tag in BLOCKS:
            holder = owner
            close()
            if child.children:
                stack.append((child, iter(child.children), child))
        else:
            stack.append((child, iter(child.children), owner))
    holder = node
    close()
    return out


def _last_text(node: Node) -> str:
    """The last text under a node that is not white space."""
    left: list = [node]
    while left:
        here = left.pop()
        if not isinstance(here, str):
            left += here.children
        elif not here.isspace():
            return here.rstrip()
    return ""


def _introduction(kept: list) -> Node | None:
    """The block right before, if it is a heading or its text ends in a colon."""
    before = next((c for c in reversed(kept) if not isinstance(c, str) or not c.isspace()), None)
    if before is None or isinstance(before, str) or before.tag not in BLOCKS:
        return None
    text = _last_text(before)
    return before if text and (before.tag in _HEADINGS or text.endswith((":", "："))) else None


def _drop_link_lists(top: Node) -> None:
    """Removes lists and boxes under a node that are mostly links (several of them), and doubtful text that is.

    Lists that a heading or a line ending in a colon introduces stay, unless the heading is of the word list,
    which goes with them."""
    order, counts = [top], {}
    for node in order:  # parents before children
        order.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        chars = linked = links = 0
        kept = []
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                chars, linked = chars + n, linked + n * node.link
            else:
                n, k, m = counts[id(c)]
                m += c.tag == "a"
                if c.doubtful and (m or node.link) and 2 * k > n:
                    continue
                if c.tag in _BOXES and m > 1 and k > 0.6 * n:
                    before = _introduction(kept)
                    if before is None:
                        continue
                    if before.tag in _HEADINGS and _listed(" ".join(blocks(before))):
                        n, k, m = counts[id(before)]
                        chars, linked, links = chars - n, linked - k, links - m
                        del kept[next(i for i in reversed(range(len(kept))) if kept[i] is before):]
                        continue
                    k = m = 0  # content: its links don't count against the boxes around it
                chars, linked, links = chars + n, linked + k, links + m
            kept.append(c)
        node.children = kept
        counts[id(node)] = (chars, linked, links)


def _with_runs(parent: Node) -> list[Node]:
    """A node's children; text and inline elements that stand together are one node without a tag."""
    out: list[Node] = []
    for c in parent.children:
        if isinstance(c, str) or c.tag not in BLOCKS and not c.points:
            if not out or out[-1].tag:
                out.append(Node("", None))
                out[-1].link = parent.link
            out[-1].children.append(c)
        else:
            out.append(c)
    return out


def _characters(node: Node) -> tuple[int, int]:
    """Characters of a node's text, and how many of them are linked."""
    own: list = []
    blocks(node, own=own)
    return sum(len(text) for _, text, _ in own), sum(linked for _, _, linked in own)


def _is_content(node: Node) -> bool:
    """Text, or a block of running text, or a box that holds one."""
    if not node.tag or node.tag in _CONTENT:
        return True
    left = [node]
    while left:
        here = left.pop()
        if here.tag in _HOLDS:
            return True
        left += [c for c in here.children if not isinstance(c, str)]
    return False


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    root = tree(page)
    own: list = []
    blocks(root, own=own)
    if not own:
        return ""
    scored: dict[int, Node] = {}
    total: dict[int, list[int]] = {}
    for holder, text, linked in own:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        share = 1
        up = (holder.parent or holder) if holder.tag in _PARAGRAPHS else holder
        while up is not None and share <= 4:
            up.points += points * (1 - min(1, linked / len(text))) / share
            scored[id(up)] = up
            up, share = up.parent, share + 1
        up = holder
        while up is not None:
            t = total.setdefault(id(up), [0, 0])
            t[0] += len(text)
            t[1] += linked
            up = up.parent
    for k, n in scored.items():
        n.points *= 1 - min(1, total[k][1] / total[k][0]) if k in total else 1
    best = max(scored.values(), key=lambda n: n.points)  # the first of equals in page order
    for wanted in ("article", "main"):
        up = best
        while up is not None and up.tag != wanted:
            up = up.parent
        if up is not None:
            _drop_link_lists(up)
            return " ".join(blocks(up))
    if best.parent is None:
        _drop_link_lists(best)
        return " ".join(blocks(best))
    parts = []
    for sibling in _with_runs(best.parent):
        t = total.get(id(sibling)) or _characters(sibling)
        if sibling is best or sibling.points >= max(10, 0.2 * best.points) or (
                t[0] > 0 and t[1] < 0.25 * t[0] and _is_content(sibling)):
            _drop_link_lists(sibling)
            parts += blocks(sibling)
    return " ".join(parts)


def _extract(batches):
    for b in batches:
        texts = [main_text(p) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages(page_id, url, html)``."""
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(_extract, "page_id long, url string, text string"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
