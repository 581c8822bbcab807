"""HTML extraction by consensus of a host: pages vote on the path of their best container, then the articles around it are read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import settle
from kinewatch.llm.url_rules import url_host

#: Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead
 tr ul""".split())
CONTAINER = set("article body div main section td".split())
DROPPED = set("annotation annotation-xml aside button canvas datalist dialog footer form head menu nav object search select svg".split())
#: Elements that end an open drawing or formula, and those that hold other elements of a page inside of one.
FOREIGN = {"svg", "math"}
BREAKOUT = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s
 small span strike strong sub sup table tt u ul var""".split())
HOLDS_HTML = set("foreignobject desc annotation-xml mi mo mn ms mtext".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or an id that mark other things than the article, and those that mark it.
OTHER = set("""ad ads adsbygoogle adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
 disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo
 promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
 teaser toolbar widget""".split())
ARTICLE = set("article body content entry main post story text".split())
#: Names of one article as a whole.
WHOLE = set("article entry post story".split())
#: Words of OTHER that name what readers wrote.
READERS = set("comment comments disqus replies reply respond".split())
#: What OTHER may come in numbers of (related posts), without another meaning.
MANY = set("articles entries posts stories".split())
#: Words that may follow one of OTHER in a name without another meaning, and elements that a name never drops.
LAYOUT = set("""area bar block bottom box button buttons column container content form group holder icon icons inner item items left link links list
 menu message outer panel row section slot text top unit wrap wrapper""".split())
SPARED = {"body", "html", "main", "p", "pre", "blockquote"} | HEADINGS
#: A named element goes if it has at most this share of the page's text, or more than this share of its own text in links.
SMALL, LINKED = 1 / 3, 1 / 2

_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
_DIGITS, _PIECES = re.compile(r"\d+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element. What is asked of the elements around it is kept on it, so nothing walks to the root."""

    __slots__ = ("tag", "label", "path", "parent", "drop", "hard", "mark", "block", "container", "headed", "article", "named", "foreign", "size", "link_size", "score", "text", "link", "hits", "inside")

    def __init__(self, tag: str, label: str, path: int, parent: "Node | None", drop: int, mark: str = ""):
        self.tag, self.label, self.path, self.parent = tag, label, path, parent  # path: its number on this page
        self.drop = self.hard = drop  # 0 read, 1 headings alone, 2 nothing; hard: by kind and role alone
        self.mark = mark  # what its names say: "", "weak", "strong", "title", "header" or "comment"
        self.size = self.link_size = self.text = self.link = self.hits = 0
        self.score, self.inside = 0.0, False
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.container = self if parent is None or tag in CONTAINER else parent.container
        self.headed = tag in HEADINGS or parent is not None and parent.headed
        self.article: Node | None = self if tag in ("article", "main") else parent.article if parent is not None else None
        self.named: Node | None = self if _named_article(label) else parent.named if parent is not None else None
        self.foreign: Node | None = self if tag in FOREIGN else None if parent is None or tag in HOLDS_HTML else parent.foreign


class Page:
    """The elements of a page in order (the first is the page), its blocks (element, text, characters in links), and paths by number."""

    def __init__(self) -> None:
        self.top = Node("", "", 0, None, 0)
        self.nodes, self.containers = [self.top], [self.top]
        self.blocks: list[tuple[Node, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}

    def number(self, parent: int, label: str) -> int:
        return self.paths.setdefault((parent, label), len(self.paths) + 1)

    def find(self, path: str) -> int | None:
        """The number of a written path, if the page has it."""
        at: int | None = 0
        for label in path.split("/")[1:]:
            at = self.paths.get((at, label))
            if at is None:
                break
        return at

    def written(self, node: Node) -> str:
        labels = []
        while node.parent is not None:
            labels.append(node.label)
            node = node.parent
        return "".join(f"/{x}" for x in reversed(labels))


def _names_other(words: list[str]) -> str:
    """What one name says: "strong" or "comment" if the word that the others describe is of OTHER, "weak" if its first is, "article" if it means that."""
    other = [w for w in words if w in OTHER]
    core = list(words)
    while len(core) > 1 and (core[-1] in LAYOUT or core[-1] in MANY):
        core.pop()
    if other and all(w in OTHER or w in LAYOUT or w in ARTICLE or w in MANY for w in words):
        if core[-1] in OTHER:  # post-comments, article-sidebar, related-posts
            return "comment" if core[-1] in READERS and READERS.issuperset(other) else "strong"
        return "article" if core[-1] in ARTICLE else "weak"
    if words[0] in OTHER:
        return "weak"
    return "article" if not ARTICLE.isdisjoint(words) else ""


@lru_cache(1 << 12)
def _mark(tag: str, names: tuple[str, ...]) -> str:
    """What class and id say of an element. Its being one article as a whole outweighs all other names, an article word in another name only weak ones."""
    if tag == "article":
        return ""
    said: set[str] = set()
    header = titled = True  # all strong names are headers; one is that of an article
    for name in names:
        words = [w.lower() for w in _PIECES.findall(name)]
        if not words:
            continue
        if all(w in WHOLE for w in words):
            return ""
        says = _names_other(words)
        said.add(says)
        if says == "strong":
            header = header and {w for w in words if w in OTHER} == {"header"}
            titled = titled and not WHOLE.isdisjoint(words)
    if "comment" in said:
        return "comment"
    if "strong" in said:
        return "strong" if not header else "title" if titled else "header"
    return "weak" if "weak" in said and "article" not in said else ""


def _hidden(named: dict[str, str]) -> bool:
    return (named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
            or "display:none" in named.get("style", "").replace(" ", "").lower())


def _open(page: Page, tag: str, attributes: str, parent: Node) -> Node:
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes else {}
    classes = named["class"].split() if "class" in named else []
    drop, mark = parent.hard, ""
    if tag in DROPPED or named and _hidden(named):
        drop = 2
    elif named and tag not in SPARED:
        mark = _mark(tag, (*classes, *named.get("id", "").split()))
    if tag == "header" and drop < 2:
        drop = 1 if parent.article is not None else 2
    label = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})]).replace("/", "|") if classes else tag
    return Node(tag, label, page.number(parent.path, label), parent, drop, mark)


def _drop_marked(page: Page) -> None:
    """Marked elements that are small beside the page or mostly links go with all below them; names of comments always count."""
    for node, text, link in page.blocks:
        node.size += len(text)
        node.link_size += link
    for node in reversed(page.nodes):  # parents come first, so sums go up from the end
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link_size += node.link_size
    total = page.top.size
    for node in page.nodes[1:]:
        drop = node.drop
        if node.mark and (node.mark == "comment" or node.link_size > LINKED * node.size or node.mark != "weak" and node.size <= SMALL * total):
            drop = max(drop, 1 if node.mark == "title" or node.mark == "header" and node.parent.article is not None else 2)
        node.drop = max(drop, node.parent.drop)


def read_page(html: str) -> tuple[list[tuple[Node, str]], Page]:
    """The blocks of a page that may be read, with the element of each, and the page, whose containers have scores.

    Where classes and ids would leave no text, they drop nothing. Time and memory grow with the page's length.
    """
    page = _parse(html)
    _drop_marked(page)
    blocks = _readable(page.blocks)
    if page.blocks and not blocks:
        for node in page.nodes:
            node.drop = node.hard
        blocks = _readable(page.blocks)
    for here, text, link in blocks:
        worth = max(0, len(text) - 2 * link)
        gain = (1 + min(worth / 100, 20) + text.count(",") / 4) if worth else 0.0
        node, share = here.container, 1.0
        while node is not None and share >= 0.25:
            node.score += gain * share
            node.text += len(text)
            node.link += link
            node, share = node.parent.container if node.parent is not None else None, share / 2
    return [(node, text) for node, text, _ in blocks], page


def _readable(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    return [b for b in blocks if b[0].drop == 0 or b[0].drop == 1 and b[0].headed]


class _Reader:
    """Follows the tags of a page: the open element, the text of the open block, and which elements are open by tag."""

    def __init__(self) -> None:
        self.page = Page()
        self.here = self.page.top
        self.open: dict[str, list[Node]] = {}
        self.parts: list[str] = []
        self.link, self.links = 0, 0  # characters of the open block inside links; open links

    def add(self, text: str) -> None:
        if self.here.hard < 2:  # phrases that aren't read (buttons, drawings) leave no words in their block
            self.parts.append(text)
            self.link += len(text) if self.links else 0

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            where = self.here if self.here.hard < 2 else self.here.block
            if text and (where.hard == 0 or where.hard == 1 and where.headed):
                self.page.blocks.append((where, text, self.link))
            self.parts, self.link = [], 0

    def leave(self, node: Node) -> None:
        """Closes the open elements up to and with this one."""
        stop = node.parent
        while self.here is not stop:
            self.open[self.here.tag].pop()
            self.here = self.here.parent

    def closing(self, tag: str) -> None:
        if not (own := self.open.get(tag)):
            return
        node = own[-1]
        if tag in BLOCK or tag in DROPPED or tag in FOREIGN or node.block is self.here.block:  # a phrase ends only inside its own block
            self.leave(node)

    def opening(self, tag: str, attributes: str) -> None:
        while self.here.tag in CLOSED_BY and tag in CLOSED_BY[self.here.tag]:
            self.leave(self.here)
        if tag in BLOCK:  # open phrases end with their paragraph
            node = self.here.block
            if node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
                self.leave(node)
        node = self.here = _open(self.page, tag, attributes, self.here)
        self.open.setdefault(tag, []).append(node)
        self.page.nodes.append(node)
        if tag in CONTAINER:
            self.page.containers.append(node)


def _parse(html: str) -> Page:
    """One pass over the text. A quote that never closes: from there on a tag ends at its first >."""
    r = _Reader()
    at, size, last, quotes = 0, len(html), html.rfind(">"), True
    while at < size:
        m = html.find("<", at)
        if m < 0 or m > last and not html.startswith("<!", m):
            r.add(html[at:])
            break
        if m > at:
            r.add(html[at:m])
        if html.startswith("<!--", m):
            end = html.find("-->", m + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith(("<!", "<?"), m):
            at = (html.find(">", m) + 1) or size
            continue
        head = _HEAD.match(html, m)
        if head is None:
            r.add("<")
            at = m + 1
            continue
        rest = _ATTRIBUTES.match(html, head.end()) if quotes else None
        quotes = rest is not None
        at = rest.end() if rest is not None else html.find(">", head.end()) + 1
        if not at:
            r.add(html[m:])
            break
        attributes = html[head.end() : at - 1]
        tag, closing = head[2].lower(), bool(head[1])
        if (foreign := r.here.foreign) is not None and tag in BREAKOUT and not closing:
            r.leave(foreign)
        if not closing and tag in RAW:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if end is None:
                break
            at = (html.find(">", end.end() - 1) + 1) or size
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                r.add(" ")
            continue
        if tag in BLOCK:
            r.flush()
        if tag == "a":
            r.links = 0 if closing else 1
        if tag in VOID:
            continue
        if closing:
            r.closing(tag)
        elif not (r.here.foreign is not None or tag in FOREIGN) or not attributes.endswith("/"):
            r.opening(tag, attributes)
    r.flush()
    return r.page


def _worth(node: Node) -> float:
    """Score of a container: paragraphs below it, less what is in links, more if it calls itself the article."""
    if not node.text or node.drop:
        return 0.0
    bonus = 1.5 if node.tag in ("article", "main") or ARTICLE & {w.lower() for w in _PIECES.findall(node.label)} - {"body"} else 1.0
    return node.score * (1 - node.link / node.text) * bonus


def best_container(html: str | None) -> tuple[str, float] | None:
    if not html:
        return None
    page = read_page(html)[1]
    best = max(page.containers, key=_worth)
    return (page.written(best), _worth(best)) if best.score else None


@lru_cache(1 << 12)
def _named_article(label: str) -> bool:
    """Whether one of the classes means one article as a whole, like post-12, and not a part of it, like post-title."""
    if "." not in label:
        return False
    names = [_PIECES.findall(c) for c in label.split(".")[1:]]
    return any(words and all(w.lower() in WHOLE for w in words) for words in names)


def _choose(page: Page, hits: list[Node]) -> None:
    """Marks as inside what is below the nearest article or main around each hit (itself counts), and all of the same path; else below
    the nearest element that names itself one. Hits with neither are read from the lowest element that holds all of them.
    """
    paths, rest = set(), 0
    for hit in hits:
        around = hit.article or hit.named
        if around is not None:
            paths.add(around.path)
        else:
            hit.hits, rest = 1, rest + 1
    common = None
    if rest:
        for node in reversed(page.nodes[1:]):
            node.parent.hits += node.hits
        common = next(n for n in reversed(page.nodes) if n.hits == rest)  # of those that hold all, one below another comes later
    for node in page.nodes:
        node.inside = node is common or node.path in paths and node.parent is not None or node.parent is not None and node.parent.inside


def extract(html: str | None, path: str | None) -> str:
    """All blocks of the articles around the page's containers of this path, or around its own best one."""
    if not html:
        return ""
    blocks, page = read_page(html)
    number = page.find(path) if path is not None else None
    hits = [n for n in page.containers if n.path == number and n.drop < 2] if number is not None else []
    if not any(map(_worth, hits)):
        hits = [max(page.containers, key=_worth)]
    _choose(page, hits)
    return "\n".join(text for node, text in blocks if node.inside)


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: the path that most of a host's pages score best (ties: the higher sum of scores, then the smaller path)."""

    def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(host, *best) for host, html in zip(f["host"], f["html"], strict=True) if (best := best_container(html))]
            yield pd.DataFrame(got, columns=["host", "path", "score"])

    cast = pages.select(url_host(F.col("url")).alias("host"), "html").mapInPandas(votes, "host string, path string, score double")
    tally = cast.groupBy("host", "path").agg(F.count("*").alias("pages"), F.round(F.sum("score"), 3).alias("score"))
    return settle(tally.groupBy("host").agg(F.min_by("path", F.struct(-F.col("pages"), -F.col("score"), "path")).alias("path")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Null or empty html, and pages without text: empty. A null url or one without a host: such pages vote as one host.
    Repeated rows are pages of their own. Very long and deeply nested pages take time and memory in proportion. Markup that isn't closed ends with the page. Empty table: empty. Other columns
    aren't read.
    """
    paths = host_paths(pages)
    keyed = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host")).join(paths, "host", "left")

    @F.pandas_udf("string")
    def main_text(html: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html, path, strict=True)], dtype=object)

    return keyed.select("page_id", "url", main_text("html", "path").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
