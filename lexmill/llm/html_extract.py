"""HTML extraction by site template removal.

Every page is parsed into a tree and its block subtrees are hashed: by their
structure (tags, class and id words, the kinds of their children; neither words
nor numbers), and also with their words. Spark counts on how many pages of a
host each hash occurs. Subtrees that recur on ``MIN_PAGES`` pages of their host
are its templates and are deleted: menus, adverts and footers go even if their
words change from page to page.

A page's main part, its article elements, or else the smallest element that
holds most of its prose, is no template: outside of it structure decides (on
pages without article elements, for mere text under no name, structure and
words), inside of it only parts without prose that recur with their words go,
as the same article may stand on many pages. On hosts with fewer than ``MIN_PAGES``
pages nothing can recur; there the markup's own declarations decide: what is in
article elements stays, or without any, what no class or id names as something
else. What HTML itself defines as no article (navigation, footers, asides,
forms, scripts and the like), elements that name themselves adverts or the like
inside an article, and reader comments go on every host.

Counts are combined before they are shuffled, so that a host may have any share
of all pages. The templates of all hosts are sent to the workers if there are
at most ``BROADCAST_ROWS``; else pages are joined with the templates they hold.

Cases: null or empty html gives an empty text; a null url, or one without
``://``, belongs to the empty host; pages that end in the middle of a tag lose
that tag alone; broken nesting is mended as browsers do for paragraphs, lists
and tables; pages of any length are read whole; repeated rows get equal
results and count each as a page; an empty table gives an empty result. Only
the named columns are read, so that others cannot clash.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, map_batches
from .url_filter import host_of

#: A subtree is a template if it is on so many pages of its host, however many the host has.
MIN_PAGES = 5
#: Counted once per page: hosts on which it recurs have pages enough to tell templates.
PAGE = 0

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?P<close>>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
CAMEL = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html tbody td tfoot th thead tr legend".split()) | {"dd", "dt"}
#: A start tag closes these if they are open, up to the elements after them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))

#: What HTML defines as no part of an article, by tag or role.
OTHER_TAGS = frozenset("head nav footer aside form script style noscript template svg canvas iframe object embed audio video button select input textarea label dialog menu title xmp noembed noframes".split())
OTHER_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words by which classes and ids name parts that are no article.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter"
    " subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead disqus share sharing social related login signup search form widget pagination".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond replies".split())
#: Elements that hold parts; others hold text, whatever their class.
PARTS = frozenset("article aside blockquote details div dl fieldset figure footer header li main nav ol section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "shape", "said", "plain", "prose", "loose", "role")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.shape = self.said = 0  # hashes of the structure, and of the structure with its words; 0 if nothing is in it
        self.plain = False  # whether nothing but text is in it, under no name
        self.prose = self.loose = 0  # characters of prose, and of text outside links
        self.role = ""  # what a class or id names the element as: "comment", "other", or (only by a part of a name) "perhaps"


class Open:
    """The open elements, with the places of each tag, so that an end tag
    finds its element, or that there is none, without a search."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)
        self.blocks: list[int] = []  # places of block elements but paragraphs

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, names, stops) -> bool:
        """Closes the last open element of these names, and what is in it,
        unless a stop is open inside of it. ``stops``: places or names."""
        last = max((self.at[n][-1] for n in names if self.at[n]), default=0)
        if isinstance(stops, list):
            stop = stops[-1] if stops else 0
        else:
            stop = max((self.at[n][-1] for n in stops if self.at[n]), default=0)
        if not last or stop > last:
            return False
        for node in self.stack[last:]:
            self.at[node.tag].pop()
        del self.stack[last:]
        while self.blocks and self.blocks[-1] >= last:
            self.blocks.pop()
        return True


def parse(page: str | None) -> Node:
    """The page's tree: parts are child nodes and decoded texts."""
    page = page or ""
    root = Node("#root", "")
    open_ = Open(root)
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            open_.stack[-1].parts.append(html_lib.unescape(page[at:m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None or not m["close"]:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag not in VOID and tag not in ("html", "body"):
                open_.close((tag,), () if tag in BLOCK else open_.blocks)
            continue
        if tag in CLOSES_P:
            open_.close(("p",), open_.blocks)
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            while open_.close(names, stops):
                pass
        node = Node(tag, m["attrs"])
        open_.stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            node.parts.append(page[at:stop])
            at = stop
        elif tag not in VOID:
            open_.push(node)
    if at < len(page):
        open_.stack[-1].parts.append(html_lib.unescape(page[at:]))
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(node.attrs)} if node.attrs.strip() else {}


def _in_order(root: Node, into=lambda n: True) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if into(node):
            stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _digest(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))


TEXT = _digest("text")


def describe(root: Node) -> None:
    """Fills in what the nodes hold, from the leaves up."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack.extend((x, linked) for x in node.parts if isinstance(x, Node))
    for node, linked in reversed(order):
        named: list[str] = []
        if attrs := attributes(node):
            named = attrs.get("class", "").lower().split() + [attrs.get("id", "").lower()]
        if node.tag in OTHER_TAGS or attrs.get("role", "").lower() in OTHER_ROLES or "hidden" in attrs:
            node.role = "other"
        elif node.tag in PARTS and attrs:
            words = {w.lower() for k in ("class", "id") for w in CAMEL.split(attrs.get(k, ""))}
            if not COMMENT_WORDS.isdisjoint(named):
                node.role = "comment"
            elif node.tag not in MAIN and not words.isdisjoint(OTHER_WORDS | COMMENT_WORDS):
                node.role = "perhaps" if OTHER_WORDS.isdisjoint(named) else "other name"
        inner, words, said = set(), [], False
        for part in node.parts:
            if isinstance(part, Node):
                if part.role != "other":
                    node.prose += part.prose
                    node.loose += part.loose
                if part.shape:
                    words.append(part.said)
                    if part.shape == TEXT:
                        said = True
                    else:
                        inner.add(part.shape)
            elif got := part.split():
                said = True
                words.extend(got)
                node.loose += 0 if linked else sum(map(len, got))
        if node.tag in PROSE and node.role != "other":
            node.prose = node.loose
        kind = node.tag in ("div", "section", "p", "br", "hr") or node.tag in HEADINGS or node.tag not in BLOCK and node.tag not in ("a", "img", "input")
        node.plain = kind and not any(named) and all(x.plain for x in node.parts if isinstance(x, Node))
        if not (inner or said or node.tag in ("img", "input")):
            continue
        if node.tag in BLOCK or node.tag in ("a", "img", "input"):
            node.shape = _digest(node.tag, re.sub(r"\d+", "0", " ".join(sorted(named))), said, *sorted(inner))
        else:  # inline markup is text, but for what is in it
            node.shape = _digest("inline", *sorted(inner)) if inner else TEXT
        node.said = _digest(node.shape, *words)


def main_parts(root: Node) -> list[Node]:
    """The page's articles; else the smallest element with most of its prose."""
    outside = lambda n: n.role not in ("other", "comment") and n.tag not in MAIN
    declared = [n for n in _in_order(root, outside) if n.tag in MAIN and n.role not in ("other", "comment")]
    if declared:
        return declared
    size = (lambda n: n.prose) if root.prose else (lambda n: n.loose)
    node = root
    while size(root):
        largest = max((x for x in node.parts if isinstance(x, Node) and x.role not in ("other", "comment")), key=size, default=None)
        if largest is None or 2 * size(largest) <= size(root) or largest.tag in PROSE or largest.tag not in BLOCK:
            return [node]
        node = largest
    return []


class Places:
    """Where nodes are: "main" is in a main part, "around" has one in it, all
    else is "beside"."""

    def __init__(self, root: Node):
        main = main_parts(root)
        self.parts = set(map(id, main))
        self.declared = any(n.tag in MAIN for n in main)
        self.loose = sum(n.loose for n in main)
        self.inside = {id(x) for m in main for x in _in_order(m)}
        self.around: set[int] = set()
        for node in reversed(_in_order(root)):
            if any(isinstance(x, Node) and (id(x) in self.parts or id(x) in self.around) for x in node.parts):
                self.around.add(id(node))

    def __call__(self, node: Node) -> str:
        return "main" if id(node) in self.inside else "around" if id(node) in self.around else "beside"

    def template_hash(self, node: Node) -> int:
        """What is counted of a node; 0 if it can be no template."""
        if node.tag not in BLOCK or node.tag in ("html", "body", "head") or not node.shape:
            return 0
        where = self(node)
        if where == "beside":  # without articles, text under no name may be content that stands apart: its words have to recur
            return node.shape if self.declared or not node.plain else node.said
        may = where == "main" and node.tag in PARTS and node.tag not in MAIN and not node.prose and 2 * node.loose <= self.loose
        return node.said if may and id(node) not in self.parts else 0


def page_hashes(page: str | None) -> list[int]:
    """The signed hashes of what may be a template, and the page's own mark."""
    root = parse(page)
    describe(root)
    places = Places(root)
    found = {places.template_hash(n) for n in _in_order(root, lambda n: n.tag != "head")}
    return [PAGE, *sorted(_signed(x) for x in found if x)]


def extract(page: str | None, templates) -> str:
    """``templates``: the signed hashes of the page's host; they decide if the
    page's mark is among them, else the markup does."""
    if not page:
        return ""
    root = parse(page)
    describe(root)
    places = Places(root)
    known = {x & ((1 << 64) - 1) for x in templates if x != PAGE}
    decided = PAGE in templates
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if words := "".join(now).split():
            blocks.append(" ".join(words))
        now.clear()

    def gone(node: Node) -> bool:
        if id(node) in places.parts:
            return False
        where = places(node)
        if node.role in ("other", "comment") or where == "main" and node.role == "other name":
            return True
        if where == "beside" and (node.tag == "header" or places.declared and (not decided or node.tag not in BLOCK)):
            return True
        if decided:
            return places.template_hash(node) in known
        return where == "beside" and node.role in ("other name", "perhaps")

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            now.append(item)
        elif gone(item):
            now.append(" ")
        elif item.tag in VOID:
            now.append(" ")
            if item.tag == "hr":
                flush()
        else:
            if item.tag in ("td", "th"):
                now.append(" ")
            elif item.tag in BLOCK:
                flush()
                stack.append(None)
            bare = places.declared and places(item) == "around"  # text beside articles that no element holds
            stack.extend(x for x in reversed(item.parts) if not (bare and isinstance(x, str)))
    flush()
    return "\n\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def recurring(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash, n) of the subtrees, and of the mark of a page, that recur
    across pages (columns host, html) of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h in page_hashes(page):
                    counts[host, h] += 1
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["host", "hash", "n"])

    counted = map_batches(pages.select("host", "html"), run, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_pages)


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    scratch = Scratch(pages.sparkSession, "html")
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    templates = scratch.save(recurring(narrow), "templates")

    if templates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for r in templates.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.hash)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        given = narrow.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        sent = None
        given = _with_own_templates(narrow, templates, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "host", "templates"))
            texts = [extract(page, own or () if sent is None else sent.value.get(host, ())) for page, host, own in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = narrow.schema["page_id"].dataType.simpleString()
    return map_batches(given.select("page_id", "url", "html", "host", "templates"), run, f"page_id {kind}, url string, text string, n_chars long")


def _with_own_templates(pages: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages with the templates among their own subtrees, by shuffled joins."""
    keyed = pages.withColumn("page_key", F.xxhash64("page_id", "url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, host, h) for k, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_key", "host", "html"))) for h in page_hashes(page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["page_key", "host", "hash"])

    own = map_batches(keyed.select("page_key", "host", "html"), run, "page_key long, host string, hash long")
    held = scratch.save(own.join(templates.select("host", "hash"), ["host", "hash"]).groupBy("page_key").agg(F.collect_set("hash").alias("templates")), "held")
    return keyed.join(held, "page_key", "left")
