"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches

#: Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video head title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption div section article main body".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends these open ones, up to the named boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Never part of an article, by tag, by role, or by a word of class or id.
OUT_TAGS = frozenset("nav footer aside form button select dialog menu fieldset label input".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer sidebar aside widget related recommended share sharing social comment comments disqus reply replies discussion respond skip".split()
)
IN_WORDS = frozenset("article body content entry main page post story text".split())
#: A token of a class that starts so tells what stands beside the element.
STATE_WORDS = frozenset("has with no without".split())
#: Words of reader comments, which go whatever they hold, and what may stand beside them in a token.
COMMENT_WORDS = frozenset("comment comments disqus discussion discussions reply replies respond response responses".split())
COMMENT_PARTS = frozenset("area block body box container count embed feed form holder list main page panel post reader section thread threads user wrap wrapper".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Not even an article of such a name, or what holds one, is the page's own.
NEVER_WORDS = frozenset("comment comments related promo ad ads".split())
#: Points of a paragraph go to so many ancestors, divided by the distance.
REACH = 3


class Node:
    __slots__ = ("attrs", "children", "comma", "link", "out", "parent", "score", "tag", "text")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score = self.text = self.link = self.comma = 0
        self.out = False


class Tree(HTMLParser):
    """A forgiving tree: implied end tags, void elements, stray end tags ignored, raw text skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open = Counter(html=1)  # open elements by tag, so that no walk looks for what is not there

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self.end({"p"}, {"button", "td", "th", "table", "article", "section", "div", "blockquote", "li"})
        if tag in IMPLIED:
            self.end(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def line(self) -> Iterator[Node]:
        n: Node | None = self.at
        while n:
            yield n
            n = n.parent

    def end(self, tags: set[str], until: set[str]) -> None:
        """Close everything up to the innermost open element of ``tags``, unless one of ``until`` is nearer."""
        if not any(self.open[t] for t in tags):
            return
        passed = []
        for n in self.line():
            passed.append(n.tag)
            if n.tag in tags and n.parent:
                self.at = n.parent
                self.open.subtract(passed)
                return
            if n.tag in until:
                return

    def handle_endtag(self, tag: str) -> None:
        self.end({tag}, {"article", "section", "main", "body"} if tag not in BLOCK else set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def walk(root: Node) -> list[Node]:
    """Elements in document order, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def tokens(node: Node) -> list[list[str]]:
    """The words of each token of class and id."""
    s = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return ["".join(c if c.isalnum() else " " for c in t).split() for t in s.split()]


def named(node: Node) -> set[str]:
    return {w for t in tokens(node) for w in t}


def says_content(node: Node) -> bool:
    """Whether a token of class or id names content and nothing else."""
    return any(IN_WORDS.issuperset(t) for t in tokens(node) if t)


@dataclass
class Page:
    """What the whole page says of its elements, by identity."""

    whole: set[int]  # holds a main, or the article with the most text
    headed: set[int]  # holds the first h1 and a paragraph
    most: set[int]  # holds at least half of the text in paragraphs


def survey(nodes: list[Node]) -> Page:
    size: dict[int, int] = {}
    said: dict[int, int] = {}
    articles, headline = [], None
    for n in reversed(nodes):  # children first
        raw = n.tag in RAW
        size[id(n)] = 0 if raw else sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in n.children)
        said[id(n)] = size[id(n)] if n.tag == "p" else 0 if raw else sum(said[id(c)] for c in n.children if isinstance(c, Node))
        if n.tag == "article" and not named(n) & NEVER_WORDS:
            articles.append(n)
        headline = n if n.tag == "h1" else headline
    chosen = [n for n in nodes if n.tag == "main"] + ([max(articles, key=lambda n: size[id(n)])] if articles else [])
    whole = above(chosen)
    paragraphs = above(n for n in nodes if n.tag == "p")
    half = said[id(nodes[0])] / 2
    return Page(whole, {id(x) for x in up(headline) if id(x) in paragraphs}, {id(n) for n in nodes if 0 < half <= said[id(n)]})


def above(chosen: Iterable[Node]) -> set[int]:
    """All that holds any of these elements."""
    out: set[int] = set()
    for n in chosen:
        for x in up(n.parent):
            if id(x) in out:
                break
            out.add(id(x))
    return out


def excluded(node: Node, in_article: bool, page: Page) -> bool:
    """Whether a subtree is chrome; an article's own header stays, as does an element that says it is content.

    A token such as ``with-sidebar`` says nothing of the element itself. An
    element with words of both kinds (``social-story``, ``comment-body``) is
    content if a token is or ends as one and it holds the headline and a paragraph.
    What holds the page's main part or article, or half of the text in
    paragraphs, stays and its children are judged. A paragraph or heading goes
    only by a token of which every word says chrome. Reader comments go whatever
    they hold.
    """
    if node.tag in RAW or node.tag in OUT_TAGS or node.attrs.get("role", "").lower() in OUT_ROLES:
        return True
    if "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag == "header":
        return not in_article
    if node.tag in ("html", "body", "main", "article"):
        return bool(named(node) & NEVER_WORDS) and node.tag == "article"
    out = OUT_WORDS - {"header"} if in_article else OUT_WORDS
    said = [t for t in tokens(node) if t and t[0] not in STATE_WORDS and out.intersection(t)]
    if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure"):
        said = [t for t in said if out.issuperset(t)]
    if any(COMMENT_WORDS.intersection(t) and COMMENT_WORDS.union(COMMENT_PARTS).issuperset(t) for t in tokens(node) if t):
        return True
    if not said or (id(node) in page.whole or id(node) in page.most) and not any(NEVER_WORDS.intersection(t) for t in said):
        return False
    own = says_content(node) or all(t[-1] in IN_WORDS for t in said)
    return not (own and id(node) in page.headed)


def blocks(root: Node) -> list[tuple[Node, str]]:
    """Visible text of ``root`` by block element, white space squashed, in page order."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []
    owner = root

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text))
        parts.clear()

    stack: list = [(root, False)]
    while stack:
        item, after = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif after:
            flush()
            owner = next((n for n in up(item.parent) if n.tag in BLOCK), root)
        elif not item.out:
            if item.tag == "br":
                parts.append(" ")
            if item.tag in BLOCK:
                flush()
                owner = item
                stack.append((item, True))
            stack += [(c, False) for c in reversed(item.children)]
    flush()
    return out


def up(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def container_of(best: Node, density: Callable[[Node], float]) -> Node:
    """The element whose parts belong together around the best container, itself if none does.

    A part of a ``main``, an article or an element that names itself content
    stands there with all its neighbours, headlines and short parts too; what is
    mostly links among them is a menu and marked to go. An article stands alone.
    """
    top, way = best, {id(best)}
    while best.tag != "article" and top.parent is not None and top.parent.tag not in ("html", "body") and (top.parent.tag in ("main", "article") or says_content(top.parent)) and density(top.parent) < 0.5:
        top = top.parent
        way.add(id(top))
    n = best
    while n is not top:
        n = n.parent
        for c in n.children:
            if isinstance(c, Node) and id(c) not in way and c.tag not in HEADINGS and c.tag != "p" and density(c) > 0.5:
                c.out = True
    return top


def main_text(html: str | None) -> str:
    """Blocks of the best container and of its siblings that score, joined by an empty line."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = walk(tree.root)
    page = survey(nodes)
    inside: set[int] = set()
    for n in nodes:
        if n.tag in ("article", "main") or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        n.out = n.parent is not None and (n.parent.out or excluded(n, id(n) in inside, page))
    for n in reversed(nodes):  # children first
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                n.text += size
                n.link += size if n.tag == "a" else 0
                n.comma += c.count(",")
            elif not c.out:
                n.text += c.text
                n.link += c.text if c.tag == "a" else c.link
                n.comma += c.comma
    scored = []
    for owner, text in blocks(tree.root):
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        own = [owner] if owner.tag not in PARAGRAPH - {"div", "section", "article", "main", "body"} else []
        for k, n in enumerate([*own, *up(owner.parent)][:REACH]):
            if not n.score:
                scored.append(n)
                n.score += {"article": 25, "main": 15}.get(n.tag, 0) + 10 * bool(named(n) & IN_WORDS)
            n.score += points / (k + 1)
    density = lambda n: n.link / n.text if n.text else 0
    for n in scored:
        n.score *= 1 - density(n)
    articles = [n for n in nodes if n.tag == "article" and not n.out and n.text]
    best = max(scored, key=lambda n: n.score, default=None)
    if articles and (best is None or best.tag != "article"):
        best = max(articles, key=lambda n: (n.score, n.text))
    if best is None:
        return ""
    if best.tag in ("html",):
        return "\n\n".join(t for _, t in blocks(best))
    top = container_of(best, density)
    kept, before = [], True
    for s in (top.parent.children if top.parent else [top]):
        before = before and s is not top
        if not isinstance(s, Node):
            continue
        fits = not s.out and s.tag not in ("header", "head") and (s.score >= max(10, 0.2 * best.score) or s.tag == "p" and density(s) < 0.25 and s.text > 80)
        if s is top or fits or before and s.tag in HEADINGS and not s.out and not any(n.tag == "h1" and not n.out for n in walk(top)):
            kept.append(s)
    return "\n\n".join(t for s in kept for _, t in blocks(s))


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the article of each whole page, without menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments.

    Null and empty pages, and pages without visible text, give an empty string.
    Malformed markup is repaired, never refused. A column named ``out`` is
    replaced. A narrow map in Arrow batches of bounded size; nothing is shuffled.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return df.withColumn(out, extract(F.col(html)))
