"""Main text of web pages by composite text density.

Every page becomes a tree of elements. Each node gets its characters, tags, link characters and link tags, from these its
composite (link-adjusted) text density, and the sum of its children's densities. The node of the largest sum is the body
of the article. The smallest density on the path from the page's body to it is the threshold: subtrees beside that path
whose density reaches the threshold belong to the text too, each by its own node of the largest sum, so an article in
several parts stays whole; where such a subtree is a mere container (div, table cell), its sum must be `SUM_SHARE` of the largest, too. What stands between two parts, and a heading before one, is judged together with them: by the density of
the whole run.

Names only weigh. An element that calls itself something else (nav, aside, footer, a class such as ad, sidebar or comments) has its
density, and those of all in it, multiplied by `NAMED_WEIGHT`; inside the article too it goes only if that leaves it below the
threshold. A page that lies whole in one such element is read like any other, for its threshold is lowered alike; only what
nav, aside, footer and their like hold is never the article's body. Scripts, styles, form controls and what isn't shown are no text at all.

Tags are told as the HTML standard's tokeniser does: an apostrophe inside an unquoted value is a character, an
open quote runs to the next one, and a tag that the page's end cuts off is dropped with all in it. Unclosed and stray tags are repaired the way
browsers do for paragraphs, list items and table cells.

Defined cases: null or empty html gives an empty text; repeated rows give one row each; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

# Element names and class words that mark what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head button select option optgroup datalist menuitem object canvas svg math audio video applet map".split()) | RAW
BARRED = frozenset("nav aside footer dialog menu".split())
NAMED = frozenset(["form"]) | BARRED
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner promo promotion sponsor sponsored sponsors sidebar sidebars aside rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related "
    "recommended recommendations widget widgets login search pagination pager paging toolbar topbar skip copyright legal disclaimer tags".split()
)
HEADER_HINTS = frozenset("header head topbar".split())
ARTICLE_HINTS = frozenset("article post entry content story main body text hentry".split())
#: has-sidebar, no-comments: such a class tells of something else than the element.
NEGATIONS = frozenset("has no not with without is".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note status toolbar".split())
NEVER_HINTED = frozenset("html body article main".split())
#: Elements that say nothing of what is in them; beside the path they need this share of the body's density sum as well.
GENERIC = frozenset("div span td th table tr center font".split())
SUM_SHARE = 0.25
#: What a name of that kind leaves of an element's density.
NAMED_WEIGHT = 0.02
#: An opening tag of the first kind ends open elements of the second, up to an element of the third.
PARAGRAPH_ENDERS = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul tr td th tbody thead tfoot".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?)?)*+"
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>{ATTRIBUTES})(?:>|(?P<cut>\Z))",
    re.S,
)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE}?))?", re.S)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    """One element: children are nodes and texts in page order. weight is the product of its own and its ancestors'."""

    __slots__ = ("name", "children", "inside_article", "named", "barred", "weight", "chars", "tags", "link_chars", "link_tags", "own", "below", "density", "total")

    def __init__(self, name: str, parent: Node | None = None, named: bool = False):
        self.name, self.children, self.named = name, [], named
        self.inside_article = parent is not None and (parent.inside_article or parent.name in ("article", "main"))
        self.barred = name in BARRED or (parent is not None and parent.barred)
        self.weight = (parent.weight if parent else 1.0) * (NAMED_WEIGHT if named else 1.0)


def attributes(rest: str) -> dict[str, str]:
    """A tag's attributes by lower-cased name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value)
    return out


def is_hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I))


def names_itself(name: str, given: dict[str, str], inside_article: bool) -> bool:
    """Whether an element's name, role, class or id says that it is something else than article text."""
    if name in NAMED or (name == "header" and not inside_article):
        return True
    if name in NEVER_HINTED:
        return False
    if given.get("role", "").lower() in ROLES or given.get("aria-modal", "").lower() == "true":
        return True
    names = [n for key in ("class", "id") for n in given.get(key, "").split()]
    whole = {n.lower() for n in names}
    if whole & HINTS:
        return True
    if whole & ARTICLE_HINTS:
        return False
    for compound in names:
        words = [w.lower() for w in WORDS.findall(compound)]
        if words and words[0] not in NEGATIONS and (HINTS.intersection(words) or (not inside_article and HEADER_HINTS.intersection(words) and not ARTICLE_HINTS.intersection(words))):
            return True
    return False


def parse(html: str, hints: bool = True) -> Node:
    """The tree of a page without what isn't text or isn't shown; hints: whether names weigh."""
    root = Node("html")
    stack, skipped = [root], 0  # skipped: open elements inside a dropped one, itself included
    skip_names: list[str] = []
    opened: Counter[str] = Counter()  # names on the stack
    at, end = 0, len(html)

    def shut(i: int) -> None:
        opened.subtract(n.name for n in stack[i:])
        del stack[i:]

    while at < end:
        match = MARKUP.search(html, at)
        text = html[at : match.start()] if match else html[at:]
        if text and not skipped:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not match:
            break
        at = match.end()
        if match["cut"] is not None:
            break
        name = (match["name"] or "").lower()
        if not name:
            if match["cdata"] and not skipped:
                stack[-1].children.append(match["cdata"])
            continue
        rest = match["rest"] or ""
        if match["close"]:
            if skipped:
                if name in skip_names:
                    while skip_names.pop() != name:
                        pass
                    skipped = len(skip_names)
                elif name in ("body", "html") or name == "article" and opened[name]:
                    skip_names.clear()
                    skipped = 0
                if skipped or name not in ("article",):
                    continue
            if opened[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        shut(i)
                        break
                    if name in INLINE and stack[i].name not in INLINE:
                        break  # a stray end of an inline element outside its block
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        empty = name in VOID or rest.rstrip().endswith("/") and name not in INLINE and name not in PARAGRAPH_ENDERS
        if skipped:
            if not empty and name not in ("p", "li", "option", "td", "th", "tr", "dt", "dd"):
                skip_names.append(name)
                skipped = len(skip_names)
            continue
        if name in ("html", "body"):
            continue
        if name in PARAGRAPH_ENDERS:  # ends an open paragraph, with the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    shut(i)
                    break
                if stack[i].name not in INLINE:
                    break
        if name in ENDS:
            ended, within = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in within:
                    break
                if stack[i].name in ended:
                    shut(i)
                    break
        given = attributes(rest) if rest.strip() else {}
        if name in DROPPED or (name not in NEVER_HINTED and is_hidden(given)):
            if not empty:
                skip_names, skipped = [name], 1
            continue
        node = Node(name, stack[-1])
        if hints and names_itself(name, given, node.inside_article):
            node = Node(name, stack[-1], named=True)
        stack[-1].children.append(node)
        if not empty:
            stack.append(node)
            opened[name] += 1
    return root


def composite(c: float, t: float, lc: float, lt: float, share: float) -> float:
    """Characters per tag, adjusted for links; share: the page's link characters per character."""
    if not c:
        return 0.0
    t, lt = max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt)) / max(1e-4, math.log(base)) if base > 1.0001 else math.log(math.e * max(1.0, c / max(1, lc) * t / lt)))


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums of all nodes; the nodes, parents before children.

    Inline formatting is transparent: it makes no tags of its own, and what stands in it counts for the block around it.
    The text that a block holds itself counts as one child in its density sum.
    """
    order = measured(root)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        own = [0, 0, 0]
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + (child.name not in INLINE or child.name == "a")
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
                if child.name in INLINE:
                    own = [x + y for x, y in zip(own, child.own, strict=True)]
            elif not child.isspace():
                node.chars += len(child)
                own[0] += len(child)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
            own = [own[0], own[0], own[2] + 1]
        node.own = own
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(order):
        node.density = node.weight * composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.below = sum(c.below if c.name in INLINE else c.density for c in node.children if isinstance(c, Node))
        c, lc, lt = node.own
        node.total = 0.0 if node.name in INLINE else node.below + node.weight * composite(c, 1 + lt, lc, lt, share)
    return order


def chosen(root: Node) -> tuple[set[int], float]:
    """Ids of the selected nodes, and the threshold.

    First the node of the largest density sum; then, beside its path from the body, subtrees that reach the threshold, and runs of
    blocks that reach it together with the parts that they stand between or, headings, before.
    """
    order = measure(root)
    parent = {id(c): n for n in order for c in n.children if isinstance(c, Node)}
    best = max((n for n in order if not n.barred), key=lambda n: n.total)
    if best.total <= 0:
        return set(), 0.0
    while inner := next((c for c in best.children if isinstance(c, Node) and not c.barred and c.name not in INLINE and c.total >= best.total), None):
        best = inner
    share = root.link_chars / root.chars
    path, node = [best], best
    while id(node) in parent:
        node = parent[id(node)]
        path.append(node)
    threshold = min(n.density for n in path)
    on_path, picked = {id(n) for n in path}, {id(best)}
    for node in path[1:]:
        shown = [c for c in node.children if isinstance(c, Node) and c.chars and c.name not in INLINE]
        part = [id(c) in on_path or (c.density >= threshold and (c.name not in GENERIC or largest(c).total >= SUM_SHARE * best.total)) for c in shown]
        for k, child in enumerate(shown):
            if part[k] and id(child) not in on_path:
                inner = largest(child)
                picked.add(id(inner if inner.total > 0 else child))
        # Runs of blocks that are no part by themselves, and the parts around them.
        k = 0
        while k < len(shown):
            if part[k]:
                k += 1
                continue
            end = k
            while end < len(shown) and not part[end]:
                end += 1
            if end < len(shown):
                first = k if k else next((j for j in range(k, end) if any(n.name in HEADINGS for n in measured(shown[j]))), end)
                run = shown[max(0, k - 1) : end + 1] if k else shown[first : end + 1]
                if first < end and together(run, share) >= threshold:
                    picked |= {id(c) for c in shown[first:end]}
            k = end
    return picked, threshold


def largest(node: Node) -> Node:
    return max(measured(node), key=lambda n: n.total)


def together(run: list[Node], share: float) -> float:
    """The density of a run of siblings as if they were one node; the least weight of theirs counts."""
    c, t, lc, lt = (sum(getattr(n, key) for n in run) for key in ("chars", "tags", "link_chars", "link_tags"))
    return min(n.weight for n in run) * composite(c, t + len(run), lc, lt, share)


def measured(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def blocks(root: Node, picked: set[int], threshold: float) -> list[str]:
    """Texts of the blocks in the picked subtrees, in page order. In them, what names itself as something else needs the threshold's density."""
    out: list[str] = []
    open_text: list[str] = []

    def close() -> None:
        if text := " ".join("".join(open_text).split()):
            out.append(text)
        open_text.clear()

    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        item, taken = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if taken:
                open_text.append(item)
        else:
            taken = id(item) in picked or (taken and not (item.named and item.density < threshold))
            if item.name not in INLINE:
                close()
                todo.append((None, False))
            todo += [(c, taken) for c in reversed(item.children)]
    close()
    return out


def main_text(html: str | None) -> str:
    """The article's text; blocks joined by one space."""
    if not html:
        return ""
    root = parse(html)
    return " ".join(blocks(root, *chosen(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, `text`: the main text of every row's whole html."""
    pages = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).cast("string").alias("row_url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    id_type = dict(pages.dtypes)["row_id"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            found = [main_text(html) for html in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["row_id", "row_url", "text"])

    out = pages.mapInArrow(texts, f"row_id {id_type}, row_url string, text string")
    return out.withColumnsRenamed({"row_id": id_col, "row_url": url_col})
