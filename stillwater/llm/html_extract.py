"""Main text of HTML pages by tree scoring.

A tolerant pass builds the tree; boilerplate elements (by tag, role or a whole class or id of a listed word) are cut, but
not for class words or a form alone if they declare or hold the main text, and never headings and paragraphs. Words that
are parts of a class, such as with-sidebar, make an element's score less and cut nothing. Each paragraph scores points for itself, its commas and its
length, and passes them to its parent, half of them to the parent's parent, and so on; elements that declare themselves
the main text get those of all paragraphs inside whole. Scores are discounted by link density, and by class words;
the best container, and siblings that score near it, are kept. Lists of links are dropped unless text of the article
stands around them: between paragraphs and headings, or under a heading. Beside the one article that has most of a
container's points, elements that follow it are reactions to it, whatever they are called. Every step takes time in
proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noframes", "svg", "math"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption option select".split()
)
#: The open elements that one of the first kind ends where it starts.
_ENDED = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "tbody": ("tr", "td", "th"),
    "tfoot": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "body": ("head",),
}
#: An implied end looks no further up than these.
_SCOPE = {"table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "body", "html", "select", "main"}
#: Ends of elements don't reach over these, but for those of the second kind.
_REGION, _THROUGH = {"td", "th", "table"}, {"table", "tr", "tbody", "body", "html", "article", "main"}
_CUT_TAGS = set(
    "head nav footer aside button select input dialog menu object embed canvas audio video search fieldset".split()
)
_CUT_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu",
    "menubar", "toolbar", "tablist",
}
_CUT_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion banner cookie cookies consent notice gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies "
    "related recommended breadcrumb breadcrumbs pagination pager toolbar widget skip copyright".split()
)
_WORDS = re.compile(r"[A-Za-z]+")
#: Factor of the score inside an element with a class of _CUT_WORDS that isn't cut, or with a part of a class.
_WORDED = 0.25
_PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}
_HOLDER = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


#: Factor of a score that declares itself an article, or whose class speaks of content.
_DECLARED = 1.25
_GOOD_WORDS = {"article", "content", "post", "entry", "story", "body", "main", "text", "prose"}
#: Lists and tables whose characters are links to this share, two links at least, are menus wherever they stand.
_MENU, _MENU_TAGS = 0.6, {"ul", "ol", "dl", "table", "center"}
#: Share of a score that goes on to the parent's parent.
_FADE = 0.5


class _Node:
    __slots__ = (
        "tag", "up", "parts", "cut", "doubt", "main", "good", "worded", "inside", "weight", "points", "score", "total", "size", "linked", "links"
    )

    def __init__(self, tag: str, up: _Node | None, cut: bool, doubt: float | None, main: bool, good: bool, worded: float = 1.0):
        self.tag, self.up, self.cut, self.doubt, self.main, self.good, self.worded = tag, up, cut, doubt, main, good, worded
        self.inside = main or up is not None and up.inside  # of something that declares itself the main text
        self.weight = 1.0
        self.parts: list[_Node | str] = []
        # own points as a paragraph; points from inside, fading and whole; characters, those in links, and links
        self.points, self.score, self.total, self.size, self.linked, self.links = 0.0, 0.0, 0.0, 0, 0, 0


def _kind(tag: str, attributes: str, up: _Node) -> tuple[bool, float | None, bool, bool, float]:
    """Whether an element is cut, its factor of the score if it may be cut (by a class, or a form), whether it declares
    itself the main text, whether its class speaks of content, and its factor for parts of classes."""
    main, doubt, good, worded = tag in _HOLDER, 1.0 if tag == "form" else None, False, 1.0
    if tag in _CUT_TAGS:
        return True, None, False, False, 1.0
    if tag == "header":
        return not up.inside, None, False, False, 1.0
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                if value.lower() in _CUT_ROLES:
                    return True, None, False, False, 1.0
                if value.lower() == "form":
                    doubt = doubt or 1.0
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True, None, False, False, 1.0
            elif name == "itemprop":
                main |= value == "articleBody"
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORDS.findall(value)}
                good |= not _GOOD_WORDS.isdisjoint(words)
                if tag in _HEADINGS or tag == "p":
                    continue
                if not _CUT_WORDS.isdisjoint(value.lower().split()):
                    doubt = _WORDED
                elif name == "class" and not _CUT_WORDS.isdisjoint(words):
                    worded = _WORDED
    return False, doubt, main, good, worded


class _Open:
    """The open elements, with counts of their tags since the last one that implied ends don't pass (scope), since the
    last cell or table (region) and in all, so that a tag that ends nothing costs no walk."""

    def __init__(self):
        self.here = self.root = _Node("#root", None, False, None, False, False)
        self.all: Counter[str] = Counter()
        self.scopes: list[tuple[_Node, Counter[str]]] = [(self.root, Counter())]
        self.regions: list[tuple[_Node, Counter[str]]] = [(self.root, Counter())]

    def push(self, node: _Node) -> None:
        self.all[node.tag] += 1
        self.scopes[-1][1][node.tag] += 1
        self.regions[-1][1][node.tag] += 1
        if node.tag in _SCOPE:
            self.scopes.append((node, Counter()))
        if node.tag in _REGION:
            self.regions.append((node, Counter()))
        self.here = node

    def pop(self) -> str:
        node = self.here
        if self.scopes[-1][0] is node:
            self.scopes.pop()
        if self.regions[-1][0] is node:
            self.regions.pop()
        for counts in (self.all, self.scopes[-1][1], self.regions[-1][1]):
            counts[node.tag] -= 1
        self.here = node.up
        return node.tag

    def end(self, tag: str) -> None:
        owner, counts = self.regions[-1]
        if self.all[tag] if tag in _THROUGH else counts[tag] or owner.tag == tag:
            while self.pop() != tag:
                pass

    def implied(self, tag: str) -> None:
        """Ends what an element of this tag ends by starting."""
        if tag in _BLOCK:
            while self.scopes[-1][1]["p"]:
                self.pop()
        ended = _ENDED.get(tag, ())
        while ended:
            owner, counts = self.scopes[-1]
            while any(counts[t] for t in ended):
                self.pop()
            if owner.tag not in ended:
                break
            while self.here is not owner:
                self.pop()
            self.pop()


def parse(page: str) -> _Node:
    """The tree of a page, with every text and element in order; unclosed and stray tags are tolerated."""
    at, size, search, opened = 0, len(page), _TOKEN.search, _Open()
    last = page.rfind(">")  # no tag ends after it, so none is looked for
    while at < size:
        m = search(page, at) if at <= last else None
        if not m:
            comment = page.find("<!--", at)
            opened.here.parts.append(page[at:] if comment < 0 else page[at:comment])
            break
        if m.start() > at:
            opened.here.parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            opened.end(tag)
            continue
        attributes = m[3] if m[2] else m[6]
        opened.implied(tag)
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at) if at <= last else None
            at = end.end() if end else size
            continue
        node = _Node(tag, opened.here, *_kind(tag, attributes, opened.here))
        opened.here.parts.append(node)
        if tag not in _VOID and (not attributes.endswith("/") or tag in _BLOCK):  # <div/> opens a div
            opened.push(node)
    return opened.root


def _settle(root: _Node) -> None:
    """Cuts the elements in doubt, except those that declare or hold the main text: one declared so, or, where none is
    declared elsewhere, more than half of the page's paragraph text. Inside an article, another is a comment on it."""
    nodes = _all(root)
    if all(n.doubt is None and n.worded == 1 for n in nodes):
        return
    within = {root: False}  # whether an article is around
    for node in nodes[1:]:
        within[node] = within[node.up] or node.up.tag == "article"
    texts = [
        (n, len(_own_text(n).strip())) if n.tag in _PARAGRAPH or n.tag in ("div", "form", *_HOLDER) else (n, 0) for n in nodes
    ]
    least = 25 if any(size >= 25 for _, size in texts) else 1
    held = {n: size if size >= least else 0 for n, size in texts}
    declared = {n: int(n.main) for n in nodes}
    for node in reversed(nodes[1:]):
        held[node.up] += held[node]
        declared[node.up] += declared[node]
    around = {root: 0}  # declared elements above
    for node in nodes[1:]:
        around[node] = around[node.up] + node.up.main
        node.weight = node.up.weight
        if node.worded < 1 and not node.main:
            node.weight = min(node.weight, node.worded)
        if node.doubt is not None:
            spared = node.main or declared[node] and not within[node]
            alone = declared[node] + around[node] == declared[root]
            if spared or alone and held[node] * 2 > held[root]:
                node.weight = min(node.weight, node.doubt)
            else:
                node.cut = True


def _own_text(node: _Node) -> str:
    """Text of a node without its block children."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if part.__class__ is str:
            out.append(part)
        elif not part.cut and part.tag not in _BLOCK:
            stack.extend(reversed(part.parts))
    return "".join(out)


def _measure(root: _Node) -> list[_Node]:
    """Sets the numbers of every node that isn't cut, from the inside out; returns them."""
    nodes = _all(root)
    for node in nodes:
        node.size += sum(len(p.strip()) for p in node.parts if p.__class__ is str)
        if node.tag in _PARAGRAPH or node.tag == "div":
            text = _own_text(node).strip()
            if len(text) >= 25:
                node.points = 1 + text.count(",") + min(len(text) / 100, 3)
    for node in reversed(nodes):
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        if node.tag == "div":  # text right in a div is the div's own
            node.score += node.points
        up = node.up
        if up:
            up.size += node.size
            up.linked += node.linked
            up.links += node.links
            up.score += (0.0 if node.tag == "div" else node.points) + _FADE * node.score
            up.total += node.total + node.points
    return nodes


def _density(node: _Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _value(node: _Node) -> float:
    """The score, less by link density and class words; whole and more for what declares itself the main text."""
    if node.main:
        score = (node.total + node.points) * (_DECLARED if node.tag == "article" else 1.0)
    else:
        score = node.score * (_DECLARED if node.good else 1.0)
    return score * (1 - _density(node)) * node.weight


def best_containers(root: _Node) -> list[_Node]:
    """The best container and the siblings kept with it, in page order."""
    _settle(root)
    nodes = _measure(root)
    held = [n for n in nodes if n.tag not in ("html", "#root") and (n.score or n.main and n.total)]
    if not held:
        holders = [n for n in nodes if n.main] or [n for n in nodes if n.tag == "body"] or [root]
        return holders[:1]
    best = max(held, key=_value)  # of equal ones the first, which holds the others
    if best.tag == "body" or not best.up:
        return [best]
    least = max(10.0, 0.2 * _value(best))
    kept = []
    for node in best.up.parts:
        if node.__class__ is str or node.cut:
            continue
        beside = best.tag == "article" and node.tag != "p" and node.tag not in _HEADINGS
        if node is not best and (node.doubt is not None or beside) and not node.main:
            continue
        long = node.tag in _HEADINGS or node.tag == "p" and node.size > 80 and _density(node) < 0.25
        if node is best or node.score and _value(node) >= least or long:
            kept.append(node)
    return kept


def _cut_reactions(best: _Node) -> None:
    """Cuts what follows the one outermost article in a container, in elements of its own, if the article has most of the
    container's points: headings, paragraphs and what stands before the article stay."""
    if best.tag == "article":
        return
    outer, stack = [], [best]
    while stack and len(outer) < 2:
        for part in reversed(stack.pop().parts):
            if part.__class__ is not str and not part.cut:
                (outer if part.tag == "article" else stack).append(part)
    if len(outer) != 1 or 2 * outer[0].total <= best.total:
        return
    node = outer[0]
    while node is not best:
        after = False
        for part in node.up.parts:
            if after and part.__class__ is not str and part.tag in _BLOCK and part.tag not in _HEADINGS and part.tag != "p":
                part.cut = True
            after |= part is node
        node = node.up


def _menu(node: _Node) -> bool:
    return node.tag in _MENU_TAGS and node.links > 1 and node.linked >= _MENU * node.size


def _is_text(part: _Node | str | None) -> bool:
    """Whether a part is a paragraph, a heading or text of the container's own."""
    return part.__class__ is str or part is not None and (part.tag == "p" or part.tag in _HEADINGS)


def _cut_menus(kept: list[_Node]) -> None:
    """Cuts lists of links, but those between paragraphs or headings and those right under a heading."""
    for top in kept:
        for node in _all(top):
            seen = [p for p in node.parts if (p.strip() if p.__class__ is str else not p.cut and (p.size or p.parts))]
            for k, part in enumerate(seen):
                if part.__class__ is str or not _menu(part):
                    continue
                around, at = seen, k
                while len(around) == 1 and node is not top and node.up:  # a wrapper: what stands around that
                    node_up = node.up
                    around = [p for p in node_up.parts if (p.strip() if p.__class__ is str else not p.cut and (p.size or p.parts))]
                    at, node = around.index(node), node_up
                before, after = around[at - 1] if at else None, around[at + 1] if at + 1 < len(around) else None
                under = before.__class__ is not str and before is not None and before.tag in _HEADINGS
                part.cut = not (under or _is_text(before) and _is_text(after))


def _all(root: _Node) -> list[_Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if p.__class__ is not str and not p.cut)
    return out


def blocks(node: _Node) -> Iterator[str]:
    """The node's blocks of text in page order, references decoded and white space run together."""
    run: list[str] = []

    def close():
        text = "".join(run)
        run.clear()
        return " ".join((html.unescape(text) if "&" in text else text).split())

    stack: list = list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if part is None:
            if text := close():
                yield text
        elif part.__class__ is str:
            run.append(part)
        elif part.cut:
            if part.tag in _BLOCK:
                stack.append(None)
        elif part.tag == "br":
            run.append("\n")
        elif part.tag in _BLOCK:
            stack.append(None)
            stack.extend(reversed(part.parts))
            stack.append(None)
        else:
            stack.extend(reversed(part.parts))
    if text := close():
        yield text


def main_text(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    kept = best_containers(parse(page))
    for node in kept:
        _cut_reactions(node)
    _cut_menus(kept)
    return "\n\n".join(b for node in kept for b in blocks(node))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html: empty text. Null ids and URLs are passed on; repeated rows each give a row; pages
    without paragraphs give the text of their body less its boilerplate. Empty table: no rows. Other
    columns are ignored.
    """
    kind = df.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInArrow(run, f"page_id long, url {kind}, text string, n_chars long")
