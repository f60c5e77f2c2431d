"""Main text of HTML pages, with site template removal.

Two things are hashed of every page's elements: whole subtrees (tag, text and
subtrees), and the skeleton of what groups others (its path of tags, classes,
roles and places among its like, without any text). Spark counts, per host, on
how many distinct pages each hash occurs (pages with the same article are one)
and how much text each skeleton holds there. Subtrees that recur on many of a
host's pages are its template and are deleted; so are recurring skeletons,
whatever their words, but for the deepest one that holds most of the host's text,
what is inside it and what it is in. Inline elements and headings never go
for their words, nor anything of an article for its skeleton.

Of what is left, the article's blocks are kept and parts that are furniture by
their tag, role or class (menus, headers, footers, sidebars, notices, adverts,
forms, comments) are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, name_package
from shardloom.llm.urlfilter import host_of

#: A subtree is template from so many pages of a host on, and from this share of its pages on.
LEAST_PAGES = 4
SHARE = 0.3
#: The skeleton that holds this share of a host's text is its content; on a page no part that holds it is template.
CONTENT = 0.5
#: Template hashes that are sent to every task at most; beyond, each page is sent its own.
MOST_BROADCAST = 200_000

# HTML element names by their role, and words of class and id names that mark furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
FURNITURE = set("nav header footer aside form script style noscript template svg iframe button select input textarea dialog object canvas head title menu audio video embed map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus respond reply replies share sharing social related recommended popup modal overlay"
    " login signup search widget toolbar skip pagination pager".split()
)
KEEP_ANYWAY = set("html body main article h1 h2 h3 h4 h5 h6 b i em strong a".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these names, looked for up to the bound names.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements that group others; only these are known by their skeleton.
GROUPS = set("address article aside body center dir div dl fieldset figure footer form header hgroup main menu nav ol search section table td ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
P_BOUND = {"button", "td", "th", "table", "caption", "object", "template", "html"}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "slot", "mass")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hash = self.slot = self.mass = 0


def parse(page: str) -> Node:
    """A tree of elements and text; never fails. Open elements end where HTML lets them."""
    root = Node("#root", "")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif m.group(2):
            tag = m.group(2).lower()
            if tag in CLOSES_P:
                _close(stack, {"p"}, P_BOUND)
            if tag in CLOSES:
                _close(stack, *CLOSES[tag])
            node = Node(tag, m.group(3))
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                stop = close.start() if close else end
                if tag in ("textarea", "title"):
                    node.children.append(page[at:stop])
                at = stop
                if close:
                    at = page.find(">", stop) + 1 or end
            elif tag not in VOID and not (m.group(3).endswith("/") and tag not in INLINE and tag in ("svg", "path")):
                stack.append(node)
        elif page.startswith("<![CDATA[", m.start()):
            stack[-1].children.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
    return root


def _close(stack: list[Node], names: set[str], bounds: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in bounds:
            return


def hash_subtrees(root: Node) -> set[int]:
    """Sets every element's hash (even; 0 if it holds no text) and mass (characters of text); returns the hashes that may be template.

    Inline elements and headings may not, and inside an article or main only what groups others.
    """
    order, todo = [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        order.append((n, inside))
        inside = inside or n.tag in ("article", "main")
        todo.extend((c, inside) for c in n.children if not isinstance(c, str))
    out = set()
    for n, inside in reversed(order):
        parts, n.mass = [n.tag], 0
        for c in n.children:
            if isinstance(c, str):
                if t := " ".join(c.split()):
                    parts.append(t)
                    n.mass += len(t)
            elif c.hash:
                parts.append(f"\x00{c.hash:x}")
                n.mass += c.mass
        if len(parts) > 1:
            n.hash = xxhash.xxh64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) >> 1 & ~1 or 2
            if n.tag in ("title", "textarea"):
                n.mass = 0
            if n.tag not in ("#root", "html", "body", "head", "main", "article") and n.tag not in INLINE and n.tag not in HEADINGS and (not inside or n.tag in GROUPS):
                out.add(n.hash)
    return out


def hash_slots(root: Node) -> dict[int, tuple[int, int]]:
    """Sets the slot (odd; 0: none) of every element that groups others; returns each slot's (mass, depth). Subtrees are hashed before.

    A slot is the path of tags, classes, ids (without digits) and roles from the
    root, with the place among like siblings. What is inside other elements than
    groups has none.
    """
    out: dict[int, tuple[int, int]] = {}
    todo = [(root, 0, 0)]
    while todo:
        n, slot, depth = todo.pop()
        like: dict[str, int] = {}
        for c in n.children:
            if isinstance(c, str):
                continue
            if c.tag not in GROUPS:
                if c.tag == "html":
                    todo.append((c, slot, depth))
                continue
            named = sorted((a.lower(), " ".join(sorted(_DIGITS.sub("", v.strip("\"'")).lower().split()))) for a, v in _NAMED.findall(c.attrs) if a.lower() in ("class", "id", "role")) if c.attrs else ()
            sign = f"{slot:x} {c.tag} {named}"
            like[sign] = at = like.get(sign, -1) + 1
            c.slot = xxhash.xxh64_intdigest(f"{sign} {at}".encode("utf-8", "surrogatepass")) >> 1 | 1
            if c.mass:
                out[c.slot] = (c.mass, depth + 1)
            todo.append((c, c.slot, depth + 1))
    return out


def prune(root: Node, template: frozenset[int] | set[int], content: float = CONTENT) -> tuple[int, int]:
    """Deletes the template's subtrees of a page, and says how many went for their words and for their skeleton.

    ``template`` has hashes, slots, and the host's content slot as a negative number.
    A part that holds ``content`` of the page's text is no template there.
    """
    gone = [0, 0]
    whole = root.mass
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        for k, c in enumerate(n.children):
            if isinstance(c, str):
                continue
            safe = inside or c.tag in ("article", "main") or -c.slot in template and c.slot
            if c.hash and c.hash in template and c.tag not in INLINE and c.tag not in HEADINGS:
                gone[0] += 1
            elif not safe and c.slot and c.slot in template and c.mass < content * whole and not _holds_article(c):
                gone[1] += 1
            else:
                todo.append((c, bool(safe)))
                continue
            n.children[k] = Node("hr", "")
    return gone[0], gone[1]


def _holds_article(n: Node) -> bool:
    todo = [n]
    while todo:
        m = todo.pop()
        if m.tag in ("article", "main"):
            return True
        todo.extend(c for c in m.children if not isinstance(c, str))
    return False


def furniture(n: Node, words: set[str] | frozenset[str] = frozenset(FURNITURE_WORDS)) -> bool:
    """Whether an element is no part of an article by its tag, role, or a class or id among ``words``."""
    if n.tag in FURNITURE:
        return True
    if not n.attrs or n.tag in KEEP_ANYWAY:
        return False
    for name, value in _NAMED.findall(n.attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in FURNITURE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
        elif words & {w.lower() for w in _WORDS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())}:
            return True
    return False


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset(), words: set[str] | frozenset[str] = frozenset(FURNITURE_WORDS)) -> str:
    """Blocks of the article, joined by a blank line; ``template`` as in :func:`prune`, ``words`` as in :func:`furniture`."""
    if not page:
        return ""
    root = parse(page)
    if template:
        hash_subtrees(root)
        hash_slots(root)
        prune(root, template)
    return _article(root, words)


def _article(root: Node, words: set[str] | frozenset[str] = frozenset(FURNITURE_WORDS)) -> str:
    """The article's blocks of a parsed page."""
    # the outermost articles or mains that are left, else the whole page
    tops, todo = [], [root]
    while todo:
        n = todo.pop()
        if n is not root and furniture(n, words):
            continue
        role = n.tag in ("article", "main") or "main" in n.attrs and re.search(r"""role\s*=\s*["']?main\b""", n.attrs)
        if role:
            tops.append(n)
        else:
            todo.extend(c for c in reversed(n.children) if not isinstance(c, str))
    blocks: list[str] = []
    for top in tops or [root]:
        run: list[str] = []

        def flush(run: list[str] = run) -> None:
            if t := " ".join(html.unescape("".join(run)).split()):
                blocks.append(t)
            run.clear()

        walk: list = [top]
        while walk:
            n = walk.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            elif n is not top and furniture(n, words):
                if n.tag not in INLINE:
                    flush()
            elif n.tag in INLINE:
                if n.tag in ("br", "td", "th"):
                    run.append(" ")
                walk.extend(reversed(n.children))
            else:
                flush()
                walk.append(None)
                walk.extend(reversed(n.children))
        flush()
    return "\n\n".join(blocks)


_COUNTED = "host string, page long, hash long, mass long, depth int"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every page (columns host, html): subtrees, slots with mass and depth, and 0 with the page's mass."""
    for b in batches:
        seen: dict[tuple[str, int, int], tuple[int, int]] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            root = parse(page.as_py() or "")
            hashes, slots = hash_subtrees(root), hash_slots(root)
            whole = root.mass
            own = xxhash.xxh64_intdigest(_article(root).encode("utf-8", "surrogatepass")) >> 1
            for h, (mass, depth) in [(0, (whole, 0)), *((h, (0, 0)) for h in hashes), *slots.items()]:
                m, d = seen.get((host, own, h), (0, 0))
                seen[host, own, h] = max(m, mass), max(d, depth)
        k, v = list(zip(*seen, strict=True)) or [()] * 3, list(zip(*seen.values(), strict=True)) or [()] * 2
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*k, *v], kinds, strict=True)], names=["host", "page", "hash", "mass", "depth"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, content: float = CONTENT) -> DataFrame:
    """(host, hash): subtrees and slots on at least ``least_pages`` and ``share`` of a host's distinct pages, see :func:`prune`.

    Pages of a host whose text without furniture is the same are one page, however
    often and with whatever around it they are given, so that an article's copies
    do not make it a template. Slots that hold ``content`` of the host's text are none;
    the deepest of them is given as a negative number. Repeats go within each batch
    and task before anything is shuffled, and a host's rows are dealt by page and
    hash, then by hash; only its slots that hold most text, a handful, meet in one
    row. ``pages`` has host and html; rows without a host or html count nowhere.
    """
    name_package(pages.sparkSession)
    once = pages.select("host", "html").where("host != ''").mapInArrow(_count, _COUNTED).groupBy("host", "page", "hash").agg(F.max("mass").alias("mass"), F.max("depth").alias("depth"))
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.max("depth").alias("depth"))
    counts = checkpointed(counts.where((F.col("n") >= least_pages) | (F.col("hash") == 0)))
    whole = counts.where("hash = 0").select(F.col("host").alias("h2"), F.col("n").alias("pages"), F.col("mass").alias("whole"))
    # one row a host on the right; a host's frequent subtrees on the left are few
    often = counts.where(F.col("hash") != 0).join(whole, F.col("host") == F.col("h2")).where(F.col("n") >= share * F.col("pages"))
    often = often.select("host", "hash", "depth", ((F.col("hash") % 2 == 1) & (F.col("mass") >= content * F.col("whole"))).alias("most"))
    deepest = often.where("most").groupBy("host").agg(F.max(F.struct("depth", "hash")).alias("m")).select("host", (-F.col("m.hash")).alias("hash"))
    return often.where("not most").select("host", "hash").union(deepest)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST, words: set[str] | frozenset[str] = frozenset(FURNITURE_WORDS)) -> DataFrame:
    """id, url, text of every page, without its site's template.

    Null and empty html have empty text; pages without a host have no
    template; repeated rows are answered each (and count as one page of their
    host); very long pages are read whole; an empty table gives no rows; other columns are not read.
    ``words`` are those of classes and ids that mark furniture; without any, such parts go
    by the template alone.
    """
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    own = checkpointed(templates(rows, least_pages, share))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string"
    if own.count() <= most_broadcast:
        sets: dict[str, set[int]] = {}
        for r in own.toLocalIterator():  # most_broadcast rows at most
            sets.setdefault(r.host, set()).add(r.hash)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [main_text(page.as_py(), sets.get(host, frozenset()), words) for host, page in zip(b.column(2).to_pylist(), b.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

        return rows.mapInArrow(run, schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, host, found = [], [], []
            for i, (h, page) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                root = parse(page.as_py() or "")
                every = [*hash_subtrees(root), *(x for s in hash_slots(root) for x in (s, -s))]
                at += [i] * len(every)
                host += [h] * len(every)
                found += every
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(host, pa.string()), pa.array(found, pa.int64())], names=["doc", "host", "hash"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), set(h.as_py() or ()), words) for page, h in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    # pages of one host and html are alike; each gets the template's hashes that it has, by a join on host and hash
    rows = rows.withColumn("doc", F.xxhash64("host", "html"))
    asked = rows.where("host != ''").select("doc", "host", "html").mapInArrow(hashes, "doc long, host string, hash long")
    lists = asked.join(own, ["host", "hash"]).groupBy("doc").agg(F.collect_set("hash").alias("hashes")).withColumnRenamed("doc", "d2")
    return rows.join(lists, rows.doc == F.col("d2"), "left").select("key", "url", "html", "hashes").mapInArrow(told, schema)
