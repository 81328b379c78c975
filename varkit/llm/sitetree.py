"""HTML extraction by a site style tree.

The pages of a host are merged into one tree.  Its element nodes are paths of block-level tags
with their classes.  A node's presentation importance is the entropy, to the base of the number
of pages that have it, of the sequences of children it has in them: a node laid out the
same on every page scores 0.  Its content importance is one minus the mean entropy of its text
blocks over the pages: blocks that repeat on all pages score 0, blocks of one page 1.  Both are
combined from the leaves up.  Branches of low importance are removed from each page, and so are single text blocks:
the leaves of a node that are on nearly all pages that have it.

The tree alone can't judge hosts with few pages, nor articles that a site repeats, so what the markup says is
heeded too: elements whose tag or class names them as page furniture are removed
on every page, and in a main element that a page marks, paragraphs, headings, lists and tables are held to the
lower limit ``LOW_IN_MAIN``, as single blocks are anywhere.  What falls under it goes only where it is the lesser part of the
text; where it is most of it, the page is a copy or near copy of an article that the site repeats, and keeps all.  A class or id names
furniture by any of its words, but for names of states (has-sidebar) and of an article's own parts (entry-header); a class, an id or a form
is no furniture where it holds most of the page's text (of the main element's, where one stands outside furniture).  Reply
words always count.  Beside a main element, its headline and the paragraphs of sections stay.

A host with few pages says little, so importances are drawn towards 1 as if ``PRIOR`` pages had shown
nothing repeated: a node with the same blocks on every page goes from 4 pages on, one in a main element from 39 on.

Statistics are sums over (host, node, feature), so a hot host is aggregated map-side and spread
over its nodes and features.  Low nodes travel back as a broadcast table when there are at
most ``BROADCAST_NODES``, else by joins on the page's own nodes.

Edge cases: NULL html is an empty page and gives an empty text; a NULL url or one without a host belongs to a
host of its own name, the empty string.  Unclosed, stray and nested tags are tolerated, with
elements deeper than ``MAX_DEPTH`` counted to their ancestor at that depth (their text stays).  Repeated rows count as pages of their own.
Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import stored
from varkit.llm.url_filter import host_of

PRIOR, LOW_IMPORTANCE, LOW_IN_MAIN, DECAY = 2.0, 0.35, 0.05, 0.9
#: Before the path in keys of branches and of blocks that are held to ``LOW_IN_MAIN``.
BRANCH, BLOCK = "!", "#"
MAX_DEPTH, BROADCAST_NODES = 24, 100_000

# Tags by role.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "option", "q", "rp", "rt", "ruby", "s", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
# Inline controls, removed with what is in them and without breaking the block around.
CONTROLS = ("button", "select")
MAIN_TAGS = {"article", "main"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
              "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "br", "hr"}
# Words in class, id and role attributes that name page furniture.
FURNITURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs",
                   "comment", "commentform", "commentlist", "comments", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu", "nav", "navbar",
                   "navigation", "newsletter", "notice", "notices", "outbrain", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share",
                   "sharing", "sidebar", "sidebars", "signup", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "widget", "widgets"}
#: Words that also name parts of an article; they count only beside words of furniture and of ``PLAIN_WORDS``, as in share-bar or page-header.
WEAK_WORDS = {"banner", "header", "notice", "notices", "share", "sharing", "widget", "widgets"}
PLAIN_WORDS = {"bar", "block", "box", "buttons", "container", "global", "links", "list", "main", "page", "site", "top", "wrapper"}
#: Words of names that tell a state or a layout of what they stand on.
STATE_WORDS = {"closed", "disabled", "enabled", "has", "hide", "is", "layout", "no", "not", "open", "with", "without"}
REPLY_WORDS = {"comment", "commentform", "commentlist", "comments", "replies", "respond", "disqus"}
#: Words of the class or id of an element whose header is an article's own.
ARTICLE_WORDS = {"article", "entry", "hentry", "post", "story"}
#: Of an element in a main element that no soft furniture is around; 1 where some is, 0 elsewhere.
FREE = 2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "article", "main", "section", "div", "body"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW + CONTROLS}


def furniture_words(names: list[str]) -> set[str]:
    """The furniture words of the class names and ids that name furniture."""
    found = set()
    for name in names:
        parts = set(NAME.findall(name))
        words = parts & FURNITURE_WORDS
        if not parts & STATE_WORDS and (words - WEAK_WORDS or parts <= FURNITURE_WORDS | PLAIN_WORDS):
            found |= words
    return found


class Node:
    """An open block-level element.  ``soft`` numbers the elements around it that are furniture unless they hold most of the text."""

    __slots__ = ("tag", "path", "children", "furniture", "soft", "main", "judged", "section")

    def __init__(self, tag, path, furniture, soft, main, judged, section=False):
        self.tag, self.path, self.furniture, self.soft, self.main, self.judged = tag, path, furniture, soft, main, judged
        self.section, self.children = section, []


class Page:
    """``blocks``: (path, text, in furniture, in the main element or its article's beside it, judged paths); ``layout``: (path, children).

    Paths are strings of block-level tags with their classes.  ``judged`` are the keys of what the style tree
    may remove the block by: paths of enclosing elements, outermost first, and the block itself.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, bool, tuple]]
        self.layout: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._found: list[tuple] = []
        self._mains: set[tuple] = set()
        self._softs = 0
        unclosed = set()
        root = Node("", "", False, (), 0, ())
        self._open = [root]
        at = 0
        while True:
            m = TOKEN.search(source, at)
            self._text.append(source[at:m.start()] if m else source[at:])
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in CONTROLS:
                end = None if tag in unclosed else ENDS[tag].search(source, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
            elif tag in ENDS:
                self._flush_if_block(tag)
                if not m[3].rstrip().endswith("/"):
                    end = ENDS[tag].search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._start(tag, m[3])
        while len(self._open) > 1:
            self._pop()
        self._flush()
        self.layout.append(("", " ".join(root.children)))
        self._judge_soft()

    def _judge_soft(self):
        free = () in self._mains
        total, held, titled = 0, {}, False
        for _, text, furniture, soft, main, _, tag, _ in self._found:
            if not furniture and (main == FREE or not free):
                total += len(text)
                titled |= main > 0 and tag == "h1"
                for e in soft:
                    held[e] = held.get(e, 0) + len(text)
        cleared = {e for e, n in held.items() if 2 * n > total}
        self.has_main = any(cleared.issuperset(soft) for soft in self._mains)
        self.blocks = []
        for path, text, furniture, soft, main, judged, tag, section in self._found:
            beside = tag == "h1" and not titled or section and tag in PARAGRAPHS
            self.blocks.append((path, text, furniture or not cleared.issuperset(soft), main > 0 or beside, judged))

    def _flush_if_block(self, tag):
        if tag not in INLINE and tag not in ("script", "style", "noscript", "template", "svg", "math"):
            self._flush()

    def _flush(self):
        if self._text:
            text = " ".join(html_lib.unescape("".join(self._text)).split())
            self._text = []
            if text:
                n = self._open[-1]
                self._found.append((n.path, text, n.furniture, n.soft, n.main, (*n.judged, _block_key(n.path, _digest(text))), n.tag, n.section))

    def _pop(self):
        self._flush()
        n = self._open.pop()
        self.layout.append((n.path, " ".join(n.children)))

    def _close(self, tag):
        if tag in INLINE:
            return
        if tag in VOID:
            self._flush()
            return
        if any(n.tag == tag for n in self._open):
            while self._open[-1].tag != tag:
                self._pop()
            self._pop()
        else:
            self._flush()

    def _start(self, tag, attributes):
        if tag in INLINE:
            return
        self._flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            for depth in range(len(self._open) - 1, 0, -1):
                if self._open[depth].tag == "p":
                    while len(self._open) > depth:
                        self._pop()
                    break
                if self._open[depth].tag in HOLDERS:
                    break
        if tag in SAME:
            for depth in range(len(self._open) - 1, 0, -1):
                if self._open[depth].tag in SAME[tag]:
                    while len(self._open) > depth:
                        self._pop()
                    break
                if self._open[depth].tag in HOLDERS:
                    break
        if tag in MAIN_TAGS or tag == "body":
            # furniture that was never closed ends where the main element begins
            for depth, n in enumerate(self._open):
                if (n.furniture or n.soft) and n.tag in FURNITURE_TAGS:
                    while len(self._open) > depth:
                        self._pop()
                    break
        names, whole, role = [], [], ""
        for a in ATTRIBUTE.finditer(attributes):
            value = (a[2] or a[3] or a[4] or "").lower()
            if a[1].lower() == "role":
                role = value.strip()
            else:
                names += NAME.findall(value)
                whole += value.split()
        parent = self._open[-1]
        words = furniture_words(whole) if tag not in ("html", "body") and tag not in MAIN_TAGS and tag not in HEADINGS else set()
        furniture = parent.furniture or tag in FURNITURE_TAGS and tag != "form" and not (tag == "header" and (parent.main or _of_article(parent))) or role in ROLES or (
            not REPLY_WORDS.isdisjoint(words)) or (
            tag in MAIN_TAGS and not {"comment", "comments", "replies"}.isdisjoint(names))
        soft = parent.soft
        if not furniture and (words or tag == "form"):
            self._softs += 1
            soft = (*soft, self._softs)
        main = parent.main or (tag in MAIN_TAGS or role == "main") * (not furniture) * (1 if soft else FREE)
        if main and not parent.main:
            self._mains.add(soft)
        label = ".".join([tag, *sorted(set(names))])
        deep = len(self._open) > MAX_DEPTH
        path = parent.path if deep else f"{parent.path}/{label}"
        if not deep:
            parent.children.append(label)
        held = tag in MAIN_TAGS or tag in ("html", "body") or deep
        key = BRANCH + path if main and tag in PARAGRAPHS else path
        judged = () if main and not parent.main else parent.judged if held else (*parent.judged, key)
        self._open.append(Node(tag, path, furniture, soft, main, judged, parent.section or tag == "section"))

    def text(self, low: set[str] | frozenset = frozenset()) -> str:
        """The main text without furniture and without the branches and blocks whose keys are in ``low``.  A
        page that consists of low branches only, as copies of one page do, keeps them."""
        kept = [(t, judged) for _, t, furniture, main, judged in self.blocks if not furniture and (main or not self.has_main)]
        left = [(t, low.intersection(judged)) for t, judged in kept]
        left = [(t, why) for t, why in left if all(k[:1] in (BRANCH, BLOCK) for k in why)]
        texts = [t for t, why in left if not why]
        if 2 * sum(map(len, texts)) < sum(len(t) for t, _ in left):
            texts = [t for t, _ in left]
        return "\n".join(texts or [t for t, _ in kept])


def _of_article(node: Node) -> bool:
    return not ARTICLE_WORDS.isdisjoint(node.path.rsplit("/", 1)[-1].split(".")[1:])


def observations(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n): how many pages of a host have a node (kind 0), have it
    with a sequence of children (1) or with a text block (2)."""
    def run(batches):
        for b in batches:
            out = {}
            for host, source in zip(b["host"], b["html"]):
                page = Page(source)
                seen = {(p, 0, 0) for p, _ in page.layout} | {(p, 1, _digest(c)) for p, c in page.layout}
                seen |= {(p, 2, _digest(t)) for p, t, furniture, *_ in page.blocks if not furniture}
                for p, kind, f in seen:
                    out[host, p, kind, f] = out.get((host, p, kind, f), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["host", "path", "kind", "feature", "n"])

    rows = pages.select("host", "html").mapInPandas(run, "host string, path string, kind int, feature long, n long")
    return rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))


def _block_key(path: str, digest: int) -> str:
    return f"{BLOCK}{path} {digest}"


def _digest(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def node_importance(counts: DataFrame) -> DataFrame:
    """(host, path, depth, pages, presentation, content, importance) of each node of each host's tree."""
    pages = counts.where("kind = 0").select("host", "path", F.col("n").alias("pages"))
    on = ["host", "path"]
    base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    share = F.col("n") / F.col("pages")
    looks = (counts.where("kind = 1").join(pages, on).groupBy(*on).agg(
        F.max("pages").alias("pages"), F.count(F.lit(1)).alias("looks"),
        F.when(F.max("pages") > 1, F.sum(-share * F.log(share) / base)).otherwise(1.0).alias("presentation")))
    texts = (counts.where("kind = 2").join(pages, on).groupBy(*on).agg(
        F.when(F.max("pages") > 1, 1 - F.avg(F.log(F.least("n", "pages").cast("double")) / base)).otherwise(1.0).alias("content")))
    tree = looks.join(texts, on, "left").withColumns({
        "depth": F.size(F.split("path", "/")) - 1, "parent": F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)})
    tree = stored(tree, "style-nodes")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, -1, -1):
        level = tree.where(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("below", F.lit(None).cast("double"))
        else:
            below = (done.where(F.col("depth") == depth + 1).groupBy("host", "parent")
                     .agg((F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("below")))
            level = level.join(below.select(F.col("host").alias("_h"), F.col("parent").alias("_p"), "below"),
                               (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
        # what is inside the node, its own text and its children, decides more the fewer its layouts
        inside = F.coalesce((F.col("content") + F.col("below")) / 2, "content", "below", "presentation")
        weight = F.pow(F.lit(DECAY), F.col("looks").cast("double"))
        own = F.when(F.col("below").isNull(), inside).otherwise((1 - weight) * F.col("presentation") + weight * inside)
        level = stored(level.withColumn("importance", own).drop("below"), "style-level")
        done = level if done is None else done.unionByName(level)
    return done


def _drawn(importance, pages, prior: float):
    return (importance * pages + prior) / (pages + prior)


def low_nodes(importance: DataFrame, prior: float = PRIOR, low: float = LOW_IMPORTANCE) -> DataFrame:
    return importance.where(_drawn(F.col("importance"), F.col("pages"), prior) < low).select("host", "path")


def low_blocks(counts: DataFrame, prior: float = PRIOR, low: float = LOW_IN_MAIN) -> DataFrame:
    """(host, path) of text blocks, by key, that are on nearly all of the pages that have their node."""
    pages = counts.where("kind = 0").select("host", "path", F.col("n").alias("pages")).where("pages > 1")
    content = 1 - F.log(F.least("n", "pages").cast("double")) / F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    return (counts.where("kind = 2 AND n > 1").join(pages, ["host", "path"]).where(_drawn(content, F.col("pages"), prior) < low)
            .select("host", F.concat(F.lit(BLOCK), "path", F.lit(" "), F.col("feature").cast("string")).alias("path")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            prior: float = PRIOR, low: float = LOW_IMPORTANCE) -> DataFrame:
    """(id, url, host, text, n_chars) per page."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), host_of(url).alias("host"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    counts = stored(observations(rows), "site-counts")
    importance = node_importance(counts)
    in_main = low_nodes(importance, prior, min(low, LOW_IN_MAIN)).select("host", F.concat(F.lit(BRANCH), "path").alias("path"))
    drop = low_nodes(importance, prior, low).unionByName(in_main).unionByName(low_blocks(counts, prior, min(low, LOW_IN_MAIN)))
    drop = stored(drop, "low-nodes")
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _url string, host string, text string"

    if drop.count() <= BROADCAST_NODES:
        by_host: dict[str, set[str]] = {}
        for r in drop.collect():
            by_host.setdefault(r.host, set()).add(r.path)
        lows = rows.sparkSession.sparkContext.broadcast(by_host)

        def run(batches):
            for b in batches:
                ids, urls, hosts, htmls = b.columns
                texts = [Page(h).text(lows.value.get(host, frozenset())) for h, host in zip(htmls.to_pylist(), hosts.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, urls, hosts, pa.array(texts, pa.string())], ["_id", "_url", "host", "text"])

        out = rows.mapInArrow(run, schema)
    else:
        out = _extract_joined(rows, drop, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "host", "text",
                      F.length("text").cast("long").alias("n_chars"))


def _extract_joined(rows: DataFrame, drop: DataFrame, schema: str) -> DataFrame:
    """The same with the low nodes joined to each page's own nodes."""
    def paths(batches):
        for b in batches:
            out = [(int(k), host, p) for k, host, h in zip(b["_key"], b["host"], b["html"]) for p in {q for x in Page(h).blocks for q in x[4]}]
            yield pd.DataFrame(out, columns=["_key", "host", "path"])

    keyed = stored(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed-pages")
    mine = keyed.select("_key", "host", "html").mapInPandas(paths, "_key long, host string, path string")
    found = mine.join(drop, ["host", "path"]).groupBy("_key").agg(F.collect_set("path").alias("_low")).withColumnRenamed("_key", "_k")

    def run(batches):
        for b in batches:
            ids, urls, hosts, htmls, low = b.columns
            texts = [Page(h).text(set(x or ())) for h, x in zip(htmls.to_pylist(), low.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, urls, hosts, pa.array(texts, pa.string())], ["_id", "_url", "host", "text"])

    return keyed.join(found, F.col("_key") == F.col("_k"), "left").select("_id", "_url", "host", "html", "_low").mapInArrow(run, schema)
