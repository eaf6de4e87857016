"""HTML extraction by site template removal.

A page is parsed into its element tree, and each subtree outside the main content is hashed twice: whole (tag, class
and id, and all text and tags below it), and as a skeleton (tag, class and id, whether most of its text is links, and
the skeletons below it, of which equal neighbours count as one), so that a menu or an advert with other words or more
items on every page is still the same. Spark counts, for each host, on how many of its pages a hash occurs; subtrees
on at least MIN_PAGES pages and MIN_SHARE of the host's pages are the host's template and are deleted before the text is
taken. Pages of a host with the same main text, taken without templates, count as one, so that copies of a page under many
ids and urls don't make its own text a template.

Main content are the ``article``, ``main`` or ``role=main`` elements with text, else the body; several articles of a page
all count, but for teasers, short ones with a link. What lies in a menu, footer, sidebar or the like isn't main content. Inside an article a recurring subtree goes only if it is equal as
a whole and holds a link or a control: a paragraph that pages share is still part of their articles. On a page without an
article a skeleton counts only if most of its text is links, since the skeletons of plain paragraphs are alike everywhere.

Elements whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert, form or comments go too
(``names``): hosts with few pages have no template, and a notice may be on few pages. They are counted like all others. A class, id,
role or form never takes main content with it: an element that holds some, or on a page without an article most of
the text, stays, unless it names comments. Of articles inside and outside such elements those outside are the page's. Hidden elements go.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed and empty
ones left out, and the blocks are joined by an empty line.

Shuffles: distinct (host, main text's hash, hash) and their counts, with partial aggregation; the hashes of a page that
are template, by host and hash and then by page; the pages once, by id. The joins read written tables, so that Spark can
split a host or a page that a third of all rows have. Cases: null and empty html give an empty text; a null or odd url is the host "";
rows equal in id, url and html each get the same result, and so do ties of ids with other html; null ids are a key of
their own; a very long page is parsed in time linear in its length, by one task; an empty table gives an empty result;
other input columns don't matter. Unclosed, misnested and cut-off markup is read to its end.
"""

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.llm.common import quoted, stored, table

MIN_PAGES, MIN_SHARE = 10, 0.2

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea select".split())
DROPPED = frozenset("nav footer header aside form head title button dialog menu label fieldset".split()) | RAW
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_PARTS = r"(?:[-_](?:box|bar|wrap|wrapper|container|list|links?|section|area|block|unit|slot|posts?|articles?|stories|items?|content|inner|outer|top|bottom|left|right|header|title|form|banner|buttons?|icons?|media|signup|trail|body|text|author|meta|reply|\d+))*"
#: Whole names in class and id: one of these, with words before it and parts of a layout after it.
NOISE = re.compile(
    r"(?:^|\s)(?:(?:[a-z0-9]+[-_]){0,3}(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe\w*|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|topbar|toolbar|pagination|pager|share|sharing|social|"
    r"comments?|commentlist|disqus|respond|replies|login|signup|search)|side|related|recommended|"
    r"(?:cookies?|site|page|top|legal|privacy|copyright|gdpr|consent)[-_]notice|notice)" + _PARTS + r"(?=$|\s)"
)
#: Before a name, words by which a layout says that it has such a part: has-sidebar, no-banner.
HAVING = re.compile(r"(?:^|(?<=\s))(?:has|have|with|without|no|is|not|hide|show)[-_]\S+")
#: Names of reader comments, which go even where they hold most of a page.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements that may be put around a whole page.
WRAPPERS = frozenset("form fieldset label".split())
#: Share of a text that is most of it.
MOST = 0.5
#: A teaser has links, and less than this share of the characters of the longest article.
TEASER = 0.25
#: A quote opens a value only after "=", and an unclosed one runs to the end; so every match goes on from where the last ended.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    """An element: its tag, attributes, and children, which are elements or texts. `survey` adds what is below it: its
    characters, of them those of links, whether it holds a link or control, and whether it is or holds main content; and
    whether it lies in main content. `removable` adds the hashes of its subtree."""

    __slots__ = ("attrs", "chars", "children", "inside", "linked", "links", "main", "skeleton", "tag", "whole")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.whole = tag, attrs, [], None


class _Open:
    """The stack of open elements, with the places of those that rules ask for, so that closing needs no search."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.stops = [root], {}, {name: [0] for name in _STOPS}

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        for name, tags in _STOPS.items():
            if node.tag in tags:
                self.stops[name].append(at)

    def close(self, tags: frozenset | set, stop: str | None = None) -> None:
        """Close the innermost open element of tags, unless an element of the stop group lies within it."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if not at or (stop and self.stops[stop][-1] > at):
            return
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
            for places in self.stops.values():
                if places[-1] == len(self.nodes):
                    places.pop()


_STOPS = {"p": LISTS | DROPPED | {"article", "main", "section", "div"}, "item": LISTS}
_P = frozenset({"p"})


def parse(page: str) -> Node:
    """The element tree of a page, in one pass. Raw elements keep no content."""
    root = Node("html", {})
    stack, at, n = _Open(root), 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack.nodes[-1].children.append(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            stack.close({tag})
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            stack.close(_P, "p")
        elif tag in ITEMS:
            stack.close(ITEMS[tag], "item")
        attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(found[3])} if found[3].strip() else {}
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in RAW or tag == "title":
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            stack.push(node)
    return root


def _named(node: Node) -> str:
    return HAVING.sub("", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".strip().lower())


def hidden(node: Node) -> bool:
    return "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(node.attrs.get("style", "")))


def dropped(node: Node, inside: bool, names: bool = True, least: float | None = None) -> bool:
    """Whether an element goes by its own name; inside: of main content, whose own header stays. Without names, only what
    is never text goes. least: the characters outside links that make an element one that holds most of the text; such
    a one, and one that holds main content, doesn't go by class, id or role, nor a form around it. None inside an article."""
    if not names:
        return node.tag in RAW or node.tag in ("head", "title")
    if node.tag in DROPPED and node.tag not in WRAPPERS:
        return not (inside and node.tag == "header")
    if hidden(node):
        return True
    named = _named(node)
    if least is not None and (node.main or node.chars - node.links > least) and not COMMENTS.search(named):
        return False
    if node.tag in WRAPPERS or node.attrs.get("role", "").lower() in ROLES:
        return True
    return bool(named) and node.tag not in ("article", "main", "body") and bool(NOISE.search(named))


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main"


def _digest(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest("\x1f".join(parts).encode("utf-8", "replace")), "big", signed=True)


def survey(root: Node) -> list[Node]:
    """The nodes of a tree, each after its parent, with what is below them."""
    root.inside, order = False, [root]
    for node in order:  # grows as it goes
        inside = node.inside or is_main(node)
        for c in node.children:
            if isinstance(c, Node):
                c.inside = inside
                order.append(c)
    for node in reversed(order):
        node.chars = node.links = 0
        node.linked, node.main = node.tag in ("a", "button", "input"), is_main(node)
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.links += c.links
                node.linked = node.linked or c.linked
                node.main = node.main or c.main
            else:
                node.chars += len(c.strip())
        if node.tag == "a":
            node.links = node.chars
    return order


def _hash(node: Node) -> None:
    """Its subtree's hashes, whole and as a skeleton, from those of its children."""
    own = (node.tag, node.attrs.get("class", ""), node.attrs.get("id", ""))
    whole, bones = [], []
    for c in node.children:
        if isinstance(c, Node):
            whole.append(str(c.whole))
            if not bones or bones[-1] != c.skeleton:
                bones.append(c.skeleton)
        else:
            whole.append(" ".join(c.split()))
    node.whole = _digest(*own, *whole)
    node.skeleton = _digest(*own, "links" if node.links * 2 >= node.chars > 0 else "text", *map(str, bones))


def removable(root: Node, order: list[Node]) -> list[tuple[Node, tuple[int, ...]]]:
    """order: the surveyed nodes. (node, hashes) of the subtrees that may be template, those that names drop included: outside the main content
    by the whole and the skeleton, inside an article by the whole if it holds a link. Only they and what is below them
    are hashed."""
    out, needed = [], set()
    for node in order[1:]:
        may = not node.main if not node.inside else node.linked and node.tag not in INLINE and not is_main(node)
        if may:
            out.append(node)
        if may or id(node) in needed:
            needed.add(id(node))
            needed.update(id(c) for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        if id(node) in needed:
            _hash(node)
    skeletons = lambda n: not n.inside and (root.main or n.links * 2 >= n.chars > 0)
    return [(n, (n.whole, n.skeleton) if skeletons(n) else (n.whole,)) for n in out]


def _blocks(top: list[Node], gone: set[int], names: bool, least: float | None = None) -> list[str]:
    """The texts below the nodes top, which are main content, or the root. least: as in dropped, until an article is met."""
    blocks, words = [], []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(words)).split()):
            blocks.append(text)
        words.clear()

    todo: list = [(n, n.tag != "html", None if n.tag == "article" else least) for n in reversed(top)]
    while todo:
        item, inside, most = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            words.append(item)
        elif id(item) not in gone and not dropped(item, inside, names, most):
            if item.tag in ("br", "wbr"):
                words.append(" " if item.tag == "br" else "")
                continue
            if item.tag not in INLINE:
                flush()
                todo.append((None, inside, most))
            below = None if item.tag == "article" else most
            todo += [(c, inside or is_main(item), below) for c in reversed(item.children)]
    flush()
    return blocks


def _mains(root: Node, gone: set[int], names: bool) -> list[list[Node]]:
    """Main contents of a page in its order, those that lie in the fewest elements with a name of noise, teasers left out."""
    found, todo, least = [], [(root, 0)], math.inf
    while todo:
        node, noise = todo.pop()
        if node is not root:
            if id(node) in gone or dropped(node, False, names, least):
                continue
            noise += dropped(node, False, names)
        if is_main(node):
            inner = [c for c in node.children if isinstance(c, Node) and c.tag == "article"]
            found.append((noise, inner or [node]))
            continue
        todo += [(c, noise) for c in reversed(node.children) if isinstance(c, Node) and c.main]
    fewest = min((noise for noise, nodes in found if any(n.chars for n in nodes)), default=0)
    mains = [nodes for noise, nodes in found if noise == fewest]
    longest = max((n.chars for nodes in mains for n in nodes), default=0)
    teaser = lambda n: n.tag == "article" and 0 < n.links and (n.chars < TEASER * longest or (n.links * 2 >= n.chars and n.chars < longest))
    return [[n for n in nodes if not (names and teaser(n))] for nodes in mains]


def main_text(page: str, template: frozenset[int] | set[int] = frozenset(), names: bool = True, article: bool = True) -> str:
    """The main text of a page without the subtrees whose hash is in template, without the elements that names drop, and
    of the article alone if there is one."""
    root = parse(page)
    return "\n\n".join(_main_blocks(root, survey(root), template, names, article))


def _main_blocks(root: Node, order: list[Node], template: frozenset[int] | set[int] = frozenset(), names: bool = True, article: bool = True) -> list[str]:
    gone = {id(n) for n, hashes in removable(root, order) if not template.isdisjoint(hashes)} if template else set()
    blocks = []
    for nodes in _mains(root, gone, names) if article else []:
        least = MOST * sum(n.chars - n.links for n in nodes)
        blocks += _blocks(nodes, gone, names, least)
    return blocks or _blocks([root], gone, names, MOST * (root.chars - root.links))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found, contents = [], []
        for page in pdf["html"]:
            root = parse(page)
            order = survey(root)
            found.append(sorted({h for _, hashes in removable(root, order) for h in hashes}))
            contents.append(_digest(*_main_blocks(root, order)))
        yield pd.DataFrame({"host": pdf["host"], "k": pdf["k"], "u": pdf["u"], "content": contents, "hashes": found})


def template_counts(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of each host's template. parsed: host, content, hashes."""
    sizes = stored(parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages))
    seen = parsed.select("host", "content", F.explode("hashes").alias("hash")).distinct()
    counts = stored(seen.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages))
    common = counts.join(sizes.hint("merge"), "host").filter(F.col("n") >= min_share * F.col("pages"))
    return common.select("host", "hash")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(k, u, template): the template hashes of each page that has any. pages: host, k, u, html."""
    made = pages.select("host", "k", "u", "html").mapInPandas(_hashes, "host string, k long, u long, content long, hashes array<long>")
    parsed = stored(made)
    common = stored(template_counts(parsed, min_pages, min_share))
    rows = parsed.select("host", "k", "u", F.explode("hashes").alias("hash"))
    return stored(rows.join(common.hint("merge"), ["host", "hash"]).groupBy("k", "u").agg(F.collect_set("hash").alias("template")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True, article: bool = True) -> DataFrame:
    """(id, url, text, n_chars) of every page. Without names and article, templates alone decide what goes."""
    url, page = quoted(url_col), F.coalesce(quoted(html_col), F.lit(""))
    keyed = pages.select(
        quoted(id_col).alias("id"), url.alias("url"), page.alias("html"), host(url).alias("host"),
        F.xxhash64(quoted(id_col)).alias("k"), F.xxhash64(url, page).alias("u"),
    )
    joined = keyed.join(templates(keyed).hint("merge"), ["k", "u"], "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, template: pd.Series) -> pd.Series:
        sets = [set() if t is None else {int(h) for h in t} for t in template]
        return pd.Series([main_text(p, t, names, article) for p, t in zip(html, sets, strict=True)])

    out = joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("html", "template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_main(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
