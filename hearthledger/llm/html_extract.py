"""Main text of web pages by a site style tree.

1. Each page is read into element nodes.  A node is named by its way from the root: tag and class names (digits
   aside) and the count of like siblings before it, so that pages of a host merge into one tree.
2. Elements such as nav, footer, aside and form, and names such as "ad", "comments" or "cookie-notice", mark a branch.
   Marks decide alone only on small branches: of ``LITTLE`` words at most, or of half of the page's words at most.
   Hidden elements hold no text.
3. All other nodes are weighed by the tree, marked or not.  Over the m different pages of a host that hold a node, its
   presentation is worth the entropy of its sequences of children.  The content of a node's own text is worth one less
   the mean entropy of its features (words of short blocks, sentences of long ones) over pages; a branch's content is
   the mean of its nodes', by words.  Importance blends both; a node is removed with its branch where it is below
   ``LEAST`` (``LEAST_MARKED`` if it is marked) and at least ``PAGES`` different pages show it.  Sums of counts and of
   count * log(count) give these entropies, so Spark merges pages part by part; copies of one page count once.  Of what
   is left, article elements are taken alone where they hold at least half of the words (of main, if there is one), or
   else main is.
4. Removed nodes go to tasks as a table if they are few (``SENT`` rows), else they are joined by page.  Nodes carry
   64-bit keys of host and way.

Defined cases: null html or text-free pages give an empty text; a null or odd url is a site of its own for each page;
repeated rows, also of one id, are extracted one by one; very long pages are read whole; an empty table gives an empty table; extra columns are ignored.  Text without
markup is one block.  White space is what str.split takes for it.
"""

from __future__ import annotations

import html as entities
import re
from itertools import groupby

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

GAMMA, LEAST, LEAST_MARKED, PAGES = 0.9, 0.3, 0.6, 3
LITTLE = 30
SENTENCE = re.compile(r"(?<=[.!?\u3002\uff01\uff1f])\s*")
SENT = 50_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas audio video select datalist noembed noframes xmp".split())
BLOCK = frozenset(
    """address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
NOISE_TAGS = frozenset("nav footer aside head menu dialog button search option label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note status toolbar".split())
# Parts of class names and ids that mark what often isn't main text.
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion
    promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar
    widget widgets""".split()
)
AGAINST = frozenset("has no with without is js".split())  # "has-sidebar" tells of a page, not of a sidebar
BEGIN = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sponsor", "subscri")  # fixed values: "commentlist"
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/>]|\Z))", re.I)
CLOSE = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _named_noise(names: str, article: bool) -> bool:
    for name in names.split():
        parts = [x.lower() for x in NAMES.findall(name)]
        if "layout" in parts:
            continue
        for before, part in zip(["", *parts], parts, strict=False):
            if before not in AGAINST and (part in NOISE_NAMES or (part.startswith(BEGIN) and part != "commentary")):
                return True
        if not article and "header" in parts and not {"article", "post", "entry"} & set(parts):
            return True
    return False


def _key(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


class _Node:
    __slots__ = ("article", "children", "hidden", "kin", "main", "marks", "name", "tag", "weighed")

    def __init__(self, tag, name, hidden, marks, article, main, weighed):
        self.tag, self.name, self.hidden, self.marks, self.article, self.main, self.weighed = tag, name, hidden, marks, article, main, weighed
        self.kin: dict[str, int] = {}  # like children so far
        self.children: list[str] = []


class Page:
    """Blocks of a page, and the nodes that the tree has to weigh."""

    def __init__(self, source: str, names: bool = True, site: str = ""):
        self._names = names
        self.blocks: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # text, in an article, in main, weighed nodes around it
        self.styles: list[tuple[int, _Node]] = []
        self._pieces: list[str] = []
        self._forms: list[bool] = []  # for each marked branch: whether it is a form
        self._parts: list[tuple[str, int, _Node]] = []  # text as it stands, number of its block, node
        self._block = 0
        self._stack = [_Node("", site, False, (), False, False, ())]
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Drop the small ones of the marked branches."""
        total, words = 0, [0] * len(self._forms)
        for text, _, node in self._parts:
            n = len(text.split())
            total += n
            for m in node.marks:
                words[m] += n
        small = {m for m, n in enumerate(words) if n <= LITTLE or 2 * n <= total}
        self.styles = [x for x in self.styles if small.isdisjoint(x[1].marks)]
        left = [(text, (at, node.article, node.main, node.weighed)) for text, at, node in self._parts if small.isdisjoint(node.marks)]
        for (_, article, main, weighed), parts in groupby(left, key=lambda x: x[1]):
            text = " ".join("".join(x[0] for x in parts).split())
            if text:
                self.blocks.append((text, article, main, weighed))

    def _flush(self, ends: bool = True) -> None:
        """Ends a part; also its block, but for marked elements within a line."""
        if self._pieces:
            self._parts.append(("".join(self._pieces), self._block, self._stack[-1]))
            self._pieces = []
        self._block += ends

    def _text(self, piece: str) -> None:
        if piece and not self._stack[-1].hidden:
            self._pieces.append(entities.unescape(piece) if "&" in piece else piece)

    def _pop_to(self, depth: int) -> None:
        if any(n.tag in BLOCK for n in self._stack[depth:]):
            self._flush()
        elif self._stack[-1].marks != self._stack[depth - 1].marks:
            self._flush(False)
        del self._stack[depth:]

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                break
            self._text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in RAW:
                if tag != "svg" or not attributes.endswith("/"):  # only foreign elements may close themselves
                    shut = CLOSE[tag].search(source, at)
                    if shut is None:
                        at = size
                    else:
                        stop = source.find(">", shut.end() - 1)
                        at = size if stop < 0 else stop + 1
                continue
            self._start(tag, attributes)
        self._text(source[at:])
        self._flush()

    def _end(self, tag: str) -> None:
        stack = self._stack
        if tag == "p" and all(n.tag != "p" for n in stack):
            self._flush()
            return
        block = tag in BLOCK
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                self._pop_to(depth)
                return
            if not block and stack[depth].tag in BLOCK:
                return

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self._text(" ")
            return
        if tag in BLOCK:
            self._flush()
            if tag in CLOSED_BY:
                shut, scope = CLOSED_BY[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in scope:
                        break
                    if stack[depth].tag in shut.split():
                        self._pop_to(depth)
                        break
            elif tag not in ("html", "head"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ("p", "head"):
                        self._pop_to(depth)
                        break
                    if stack[depth].tag in BLOCK:
                        break
        if tag in VOID:
            return
        top = stack[-1]
        names = role = ""
        hidden = False
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names += " " + value
                elif key == "role":
                    role = value.strip().lower()
                elif key == "itemprop":
                    role = "main" if value == "articleBody" else role
                elif key == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key == "hidden":
                    hidden = True
                else:
                    hidden |= value.strip().lower() == "true"
        hidden |= top.hidden
        marks = top.marks
        if tag in ("article", "main"):
            marks = tuple(m for m in marks if not self._forms[m])
        marked = tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not top.article) or (names and self._names and tag not in ("html", "body") and _named_noise(names, top.article or tag in ("article", "main")))
        if marked or tag == "form":
            marks = (*marks, len(self._forms))
            self._forms.append(not marked)
            self._flush(False)
        article = top.article or (tag == "article" and not hidden)
        main = top.main or ((tag == "main" or role == "main") and not hidden)
        weighed, name = top.weighed, top.name
        if not hidden and (tag in BLOCK or marked):
            sign = tag + re.sub(r"\d+", "#", names)
            nth = top.kin[sign] = top.kin.get(sign, 0) + 1
            name = f"{name}/{sign}.{nth}"
            top.children.append(sign)
            if tag not in ("html", "body"):
                # The last bit tells whether the node is marked.
                weighed = (*weighed, _key(name) & ~1 | (marked or tag == "form"))
        node = _Node(tag, name, hidden, marks, article, main, weighed)
        stack.append(node)
        if weighed is not top.weighed:
            self.styles.append((weighed[-1], node))

    def kept(self, low=frozenset()) -> list[str]:
        left = [b for b in self.blocks if not (low and any(k in low for k in b[3]))]
        n = lambda blocks: sum(len(b[0].split()) for b in blocks)
        articles, main = ([b for b in left if b[k]] for k in (1, 2))
        if articles and 2 * n(articles) >= n(main or left):
            left = articles
        else:
            left = main or left
        return [b[0] for b in left]

    def features(self):
        """(node, ways, features, counts) of each node: ways are the nodes from the top down to this one; the first
        feature is its presentation (even), all others are content of its own text (odd)."""
        said: dict[int, dict[str, int]] = {}
        for text, _, _, around in self.blocks:
            if around:
                own, words = said.setdefault(around[-1], {}), text.split()
                for f in words if len(words) <= LITTLE else SENTENCE.split(text):
                    if f:
                        own[f] = own.get(f, 0) + 1
        for way, node in self.styles:
            short = [x for i, x in enumerate(node.children) if i == 0 or node.children[i - 1] != x]
            own = said.get(way, {})
            yield way, node.weighed, [_key("\x1f".join(short)) & ~1, *(_key(f) | 1 for f in own)], [1, *own.values()]


def page_of(source: str, site: str = "") -> Page:
    """A page; where names alone hide all of its article or main element, these are read regardless of names."""
    page = Page(source, site=site)
    if not page.blocks:
        bare = Page(source, names=False, site=site)
        if any(b[1] or b[2] for b in bare.blocks):
            return bare
    return page


def _site(url, digest):
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", F.concat(F.lit("?"), digest.cast("string"))).otherwise(host)


def _features(batches):
    import pyarrow as pa

    kinds = {"digest": pa.int64(), "node": pa.int64(), "ways": pa.list_(pa.int64()), "features": pa.list_(pa.int64()), "counts": pa.list_(pa.int32())}

    def give(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for batch in slices(batches, 2, 1 << 20):
        done, out = set(), []
        for site, digest, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if source and (site, digest) not in done:
                done.add((site, digest))
                out += [(digest, *row) for row in page_of(source, site).features()]
                if len(out) > 5_000:
                    yield give(out)
                    out = []
        if out:
            yield give(out)


FEATURES = "digest long, node long, ways array<long>, features array<long>, counts array<int>"


def importance(features: DataFrame) -> DataFrame:
    """(node, pages, importance) of all weighed nodes of all hosts."""
    once = features.groupBy("node", "digest").agg(*(F.first(c).alias(c) for c in ("ways", "features", "counts")))
    once = once.select("node", "ways", F.explode(F.arrays_zip("features", "counts")).alias("x")).select("node", F.col("x.features").alias("feature"), F.col("x.counts").alias("n"), "ways")
    ways = F.first(F.when(F.col("feature") % 2 == 0, F.col("ways")), ignorenulls=True).alias("ways")
    each = once.groupBy("node", "feature").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), ways)
    style, said = F.col("feature") % 2 == 0, F.col("feature") % 2 != 0
    nodes = each.groupBy("node").agg(
        F.sum(F.when(style, F.col("t"))).alias("pages"),
        F.sum(F.when(style, F.col("t") * F.log("t"))).alias("style_log"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(said, F.log("t") - F.col("s") / F.col("t"))).alias("spread"),
        F.count(F.when(said, 1)).alias("features"),
        F.sum(F.when(said, F.col("t"))).alias("amount"),
        F.first("ways", ignorenulls=True).alias("ways"),
    )
    nodes = written(nodes, "nodes")
    m = F.log("pages")
    one = F.col("pages") <= 1
    nodes = nodes.withColumns({"shown": F.when(one, 1.0).otherwise((m - F.col("style_log") / F.col("pages")) / m), "said": F.when(one, 1.0).otherwise(1 - F.col("spread") / (F.col("features") * m))})
    # A node's content counts for all branches that hold it.
    held = nodes.where("amount > 0").select(F.explode("ways").alias("node"), "amount", (F.col("amount") * F.col("said")).alias("worth"))
    held = held.groupBy("node").agg((F.sum("worth") / F.sum("amount")).alias("content"))
    style_weight = 1 - F.pow(F.lit(GAMMA), F.col("styles"))
    blend = style_weight * F.col("shown") + (1 - style_weight) * F.coalesce("content", F.lit(0.0))
    return nodes.join(held, "node", "left").select("node", "pages", F.when(one, 1.0).otherwise(blend).alias("importance"))


def unimportant(features: DataFrame) -> DataFrame:
    """(node): those that go, with their branches.  The last bit of a node's key tells whether it is marked."""
    least = F.when(F.col("node").bitwiseAND(F.lit(1)) == 1, LEAST_MARKED).otherwise(LEAST)
    return importance(features).where((F.col("pages") >= PAGES) & (F.col("importance") < least)).select("node")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", sent: int = SENT) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    import pyarrow as pa

    spark = pages.sparkSession
    d = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")).withColumn("digest", F.xxhash64("html"))
    d = d.withColumn("site", _site(F.col("url"), F.col("digest")))
    features = d.select("site", "digest", "html").mapInArrow(_features, FEATURES)
    low = written(unimportant(features), "low-nodes")
    few = low.limit(sent + 1).count() <= sent  # only how many there are
    gone: frozenset[int] = frozenset()
    if few:
        gone = frozenset(r["node"] for r in low.toLocalIterator())
        d = d.withColumn("low", F.lit(None).cast("array<bigint>"))
    else:
        of_page = features.select("digest", "node").join(low, "node", "left_semi").groupBy("digest").agg(F.collect_set("node").alias("low"))
        d = d.join(of_page, "digest", "left")
    held = spark.sparkContext.broadcast(gone)

    def texts(batches):
        for batch in slices(batches, 3, 4 << 20):
            out = []
            for site, html, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                out.append(" ".join(page_of(html, site).kept(held.value if own is None else frozenset(own))) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(d.dtypes)
    return d.select("page_id", "url", "site", "html", "low").mapInArrow(texts, f"page_id {kind['page_id']}, url string, text string, n_chars long")
