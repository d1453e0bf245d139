"""Main text of web pages by site style trees.

A page becomes a tree of elements; a node's style is its path of tags and classes. The trees
of one host are merged by counting, for each node, on how many pages it stands, its shapes
(the order of its child elements, and the sizes of its texts) and its texts. A node's
presentation importance is the entropy of its shapes, 1 being the entropy of as many equal
shares as it has pages, SHAPES at most; that of an element above counts for the elements in
it, less by DECAY a level, and words in links count nothing. Its content importance is one
minus the mean entropy of its texts: a text on c of a node's m pages has the entropy log c /
log m. Both together are the importance: a menu or an advert whose words vary looks alike on all
pages, and an article doesn't. Blocks below LEAST_IMPORTANCE go, or, on sites whose pages
all look alike, those below SHARE of the site's most important node.

The counts of all hosts form a tree too. It stands in for PRIOR_PAGES pages of a host, so that hosts
of few pages are judged. Marks (tags, roles and words of classes that say that a block is no
content) lower a node's importance by MARK_PRIOR. Two exceptions are left to them alone: what
readers and forms put on a page, which varies by its nature, and nodes on fewer than LEAST_PAGES
pages of all hosts, for which there is no tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import prepared, saved, text_slices, written
from tangentia.llm.url_filter import url_parts
from tangentia.llm.words import span_hashes

LEAST_IMPORTANCE, SHARE = 0.6, 0.75
PRESENTATION = 0.7  #: of the importance; content has the rest
SHAPES = 16
DECAY, LEVELS = 0.8, 3  #: levels of elements above that count
PRIOR_PAGES = 8
LEAST_PAGES = 5
MARK_PRIOR = 0.15
#: Low nodes of all hosts that are broadcast; 8 bytes each.
SENT_NODES = 1_000_000
#: What marks say of a block: nothing, that it is no content, that it is what readers or forms put there.
UNMARKED, MARKED, FOREIGN = 0, 1, 2

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Open elements that a start tag ends, as far as the second set.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Elements without text of their own.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head".split())
#: Elements, roles and words of classes and ids that mark what is no content, and those of what readers and forms put on a page.
NO_CONTENT = frozenset("nav footer menu header".split())
ROLES = frozenset("navigation banner contentinfo menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer share sharing social toolbar pagination pager copyright legal disclaimer".split()
)
FOREIGN_CONTENT = frozenset("aside form dialog".split())
FOREIGN_ROLES = frozenset("complementary search form alert alertdialog dialog".split())
FOREIGN_MARKS = frozenset(
    "sidebar sidebars comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "related recommended widget widgets search searchform".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What ends elements whose content isn't read.
_CLOSE = {x: re.compile(f"</{x}[^>]*>", re.I) for x in "script style textarea title noscript iframe template svg math".split()}
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" \t\r\n/") else {}


def _mark(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """What an element's tag, role and names say of its content; inside: it stands in an article or main element."""
    names = {x.lower() for x in _SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}")} if attrs and tag not in ("html", "body", "main") else set()
    role = attrs.get("role", "").lower()
    if tag in FOREIGN_CONTENT or role in FOREIGN_ROLES or not FOREIGN_MARKS.isdisjoint(names):
        return FOREIGN
    if tag in NO_CONTENT and not (tag == "header" and inside) or role in ROLES or not MARKS.isdisjoint(names):
        return MARKED
    return UNMARKED


def _is_hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


class _Element:
    """An open element: tag, style path, nothing to read, mark, in an article, its children so far, parent's path."""

    __slots__ = ("children", "gone", "inside", "mark", "path", "tag")

    def __init__(self, tag: str, path: str, gone: bool, mark: int, inside: bool):
        self.tag, self.path, self.gone, self.mark, self.inside, self.children = tag, path, gone, mark, inside, []


def page_tree(page: str) -> tuple[list[tuple[str, str, float, int]], list[tuple[str, str]]]:
    """(blocks, nodes) of a page: (path, text, share of words in links, mark) and (path, shape) of its elements.

    A block is the text between the tags of elements that aren't inline; what isn't shown is left out.
    """
    blocks: list[tuple[str, str, float, int]] = []
    nodes: list[tuple[str, str]] = []
    stack = [_Element("", "", False, UNMARKED, False)]
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            own = next(x for x in reversed(stack) if x.tag not in INLINE)
            if text and not own.gone:
                n = text.count(" ") + 1
                share = min(1.0, len(html.unescape(" ".join(linked)).split()) / n)
                blocks.append((own.path, text, share, own.mark))
                own.children.append(f"#{n.bit_length()}")
            parts.clear()
        linked.clear()

    def pop_to(i: int) -> None:
        for x in reversed(stack[i:]):
            if x.tag not in INLINE and not x.gone:
                nodes.append((x.path, " ".join(x.children)))
        del stack[i:]

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        token, end, start = m[0], m[1], m[2]
        if end:
            tag = end.lower()
            if tag in VOID:
                parts.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        flush()
                    pop_to(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
        elif start:
            tag = start.lower()
            if tag == "br" or tag == "wbr":
                parts.append(" " if tag == "br" else "")
                continue
            if tag not in INLINE:
                flush()
                if tag in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            pop_to(i)
                            break
                        if stack[i].tag not in INLINE:
                            break
                if tag in SIBLINGS:
                    ends, stop = SIBLINGS[tag]
                    low = None
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in stop:
                            break
                        if stack[i].tag in ends:
                            low = i
                    if low is not None:
                        pop_to(low)
                elif tag == "body":
                    pop_to(next((i for i, x in enumerate(stack) if x.tag == "head"), len(stack)))
            if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "math", "path"):
                continue
            attrs, above = _attributes(m[3]), stack[-1]
            inside = above.inside or tag in ("article", "main")
            gone = above.gone or tag in DROPPED or _is_hidden(attrs)
            path = above.path
            if tag not in INLINE:
                names = ".".join(sorted(set(_DIGITS.sub("0", attrs.get("class", "")).split())))
                name = f"{tag}.{names}" if names else tag
                path = f"{path}/{name}"
                if not gone:
                    next(x for x in reversed(stack) if x.tag not in INLINE).children.append(name)
            stack.append(_Element(tag, path, gone, max(above.mark, _mark(tag, attrs, above.inside)), inside))
            if tag in _CLOSE:
                stack.pop()
                closed = _CLOSE[tag].search(page, at)
                at = closed.end() if closed else len(page)
        elif token[0] != "<" or len(token) == 1:
            parts.append(token)
            if any(x.tag == "a" for x in stack):
                linked.append(token)
    flush()
    pop_to(0)
    return blocks, nodes


def _hashes(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(b) for b in raw], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.diff(ends, prepend=0), ends).view(np.int64) if raw else np.empty(0, np.int64)


def _parsed(pages: DataFrame) -> DataFrame:
    """The rows with blocks of (node, feature, linked, mark, text) and nodes of (node, parent, shape) in place of html."""
    names = [c for c in pages.columns if c != "html"]
    block = "struct<node:long,feature:long,linked:double,mark:int,text:string>"
    schema = f"{pages.select(names)._jdf.schema().toDDL()}, blocks array<{block}>, nodes array<struct<node:long,parent:long,shape:long>>"

    def lists(per_page: list[list], columns: list[tuple[str, pa.Array]]) -> pa.Array:
        at = np.concatenate([[0], np.cumsum([len(p) for p in per_page])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([x for _, x in columns], [n for n, _ in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            trees = [page_tree(h) if h else ([], []) for h in batch.column("html").to_pylist()]
            flat = [b for blocks, _ in trees for b in blocks]
            paths, texts, linked, marks = ([b[i] for b in flat] for i in range(4))
            blocks = [("node", pa.array(_hashes(paths))), ("feature", pa.array(_hashes(texts))), ("linked", pa.array(linked, pa.float64())), ("mark", pa.array(marks, pa.int32())), ("text", pa.array(texts, pa.string()))]
            flat = [x for _, nodes in trees for x in nodes]
            nodes = [("node", pa.array(_hashes([x[0] for x in flat]))), ("parent", pa.array(_hashes([x[0].rpartition("/")[0] for x in flat]))), ("shape", pa.array(_hashes([x[1] for x in flat])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists([b for b, _ in trees], blocks), lists([x for _, x in trees], nodes)], [*names, "blocks", "nodes"])

    return pages.mapInArrow(run, schema)


def _sums(counts: DataFrame, *key: str) -> DataFrame:
    """By key and node: pages, n, nl (of texts), k, kl (of shapes), linked, parent; nl and kl: sums of c log c."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    c, logs = F.col("c"), F.col("c") * F.log("c")
    return counts.groupBy(*key, "node").agg(of(0, c).alias("pages"), of(1, c).alias("n"), of(1, logs).alias("nl"), of(2, c).alias("k"), of(2, logs).alias("kl"), F.sum("linked").alias("linked"), F.min("parent").alias("parent"))


def _parts(prefix: str = "") -> tuple[Column, Column]:
    """(presentation, content) importance from _sums; a node on one page has 1."""
    pages = F.col("pages")
    shapes = (F.log("k") - F.col("kl") / F.col("k")) / F.log(F.least(pages, F.lit(SHAPES)))
    content = 1 - F.col("nl") / F.col("n") / F.log("pages")
    alone = pages < 2
    return F.when(alone, 1.0).otherwise(F.least(shapes, F.lit(1.0))).alias(f"{prefix}shapes"), F.when(alone, 1.0).otherwise(content).alias(f"{prefix}content")


def style_importance(parsed: DataFrame) -> DataFrame:
    """(host, node, importance, best) of the nodes with texts of the merged style trees, best being the host's largest; parsed: host, blocks, nodes.

    Nodes on fewer than LEAST_PAGES pages of all hosts are left out.
    """
    none, zero = F.lit(None).cast("long"), F.lit(0.0)
    row = lambda kind, node, value, parent, linked: F.struct(F.lit(kind).alias("kind"), node.alias("node"), value.alias("value"), parent.alias("parent"), linked.alias("linked"))
    there = F.array_distinct(F.transform("nodes", lambda x: row(0, x["node"], F.lit(0).cast("long"), x["parent"], zero)))
    shapes = F.transform("nodes", lambda x: row(2, x["node"], x["shape"], none, zero))
    texts = F.array_distinct(F.transform("blocks", lambda b: row(1, b["node"], b["feature"], none, b["linked"])))
    counts = parsed.select("host", F.explode(F.concat(there, shapes, texts)).alias("x")).groupBy("host", "x.node", "x.kind", "x.value")
    counts = saved(counts.agg(F.count("*").alias("c"), F.sum("x.linked").alias("linked"), F.min("x.parent").alias("parent")))
    everywhere = counts.groupBy("node", "kind", "value").agg(F.sum("c").alias("c"), F.sum("linked").alias("linked"), F.min("parent").alias("parent"))
    all_sums = _sums(everywhere, *()).select("node", F.col("pages").alias("all_pages"), *_parts("all_"))
    own = _sums(counts, "host").select("host", "node", "parent", "pages", "n", (F.col("linked") / F.col("n")).alias("share"), *_parts()).join(all_sums, "node")
    weight = F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    mixed = lambda x: weight * F.col(x) + (1 - weight) * F.col(f"all_{x}")
    own = saved(own.select("host", "node", "parent", "n", "all_pages", "share", mixed("shapes").alias("shapes"), mixed("content").alias("content")))
    above = own.select("host", F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("shapes").alias("upper"))
    out = own.filter("n > 0")
    for k in range(1, LEVELS):
        out = out.join(above, ["host", "parent"], "left").withColumn("shapes", F.greatest("shapes", F.col("upper") * DECAY**k)).drop("parent", "upper").withColumnRenamed("next", "parent")
    out = out.select("host", "node", "all_pages", (PRESENTATION * F.col("shapes") * (1 - F.col("share")) + (1 - PRESENTATION) * F.col("content")).alias("importance"))
    out = saved(out.filter(F.col("all_pages") >= LEAST_PAGES).drop("all_pages"))
    return out.join(out.groupBy("host").agg(F.max("importance").alias("best")), "host")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """The rows of pages without html_col, with text and n_chars; columns of these names are replaced.

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by one space in page order. Null and empty pages have an empty text; pages without
    a host form one site. Rows stay as they are, and repeated rows count as pages. Pages are parsed once, into a
    table in the shared folder. The counts of all pages of a host are taken before shuffling; the pages meet their host's nodes
    where they are, or, if these are more than SENT_NODES, by a join that splits large hosts.
    """
    prepared(pages.sparkSession)
    host = url_parts(pages[url_col])[0]
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    row = F.struct(*[pages[c] for c in keep]).alias("row")
    parsed = written(_parsed(pages.select(row, host.alias("host"), pages[html_col].alias("html"))))
    found = style_importance(parsed.select("host", "blocks", "nodes"))
    least = F.least(F.lit(least_importance), SHARE * F.col("best"))
    judged = found.groupBy("host").agg(
        F.collect_list("node").alias("judged"),
        F.collect_list(F.when(F.col("importance") < least, F.col("node"))).alias("low"),
        F.collect_list(F.when(F.col("importance") - MARK_PRIOR < least, F.col("node"))).alias("lowest"),
    )
    judged = saved(judged)
    nodes = judged.agg(F.sum(F.size("judged"))).first()[0] or 0
    # Few nodes in all are sent to the pages; many meet them by a shuffle, which splits large hosts.
    met = parsed.drop("nodes").join(F.broadcast(judged) if nodes <= SENT_NODES else judged, "host", "left")
    known = lambda b: F.coalesce(F.array_contains("judged", b["node"]), F.lit(False))
    low = lambda b: F.when(b["mark"] == MARKED, F.array_contains("lowest", b["node"])).otherwise(F.array_contains("low", b["node"]))
    gone = lambda b: (b["mark"] == FOREIGN) | F.when(known(b), low(b)).otherwise(b["mark"] == MARKED)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~gone(b)), lambda b: b["text"]), " ")
    return met.select("row.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
