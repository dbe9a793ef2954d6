"""Main text of web pages by a site style tree.

A page is parsed once into blocks of text, each with the node of its site's tree that it stands in: the elements of all pages of
a host are merged by path (tags, class and id names, and what markup says of them, from the root). Of a node that ``m`` distinct pages show,

* the presentation importance is the entropy of the sequences of child elements that these pages have there,
* the content importance is the mean, over the distinct texts in the whole branch, of one minus the entropy of the pages that
  show the text at its place, so it is carried up from the leaves to every node above,

both with the logarithm to the base m, so from 0 to 1; both are 1 where fewer than ``min_pages`` pages show a node:

    importance = (1 - g) * presentation + g * content

with g = ``GAMMA``, and ``NAMED`` for a box that markup gives a name of frames (adverts, comments, sign-up and the like): such a box must differ from
page to page in its structure, too, as what a template repeats has fresh texts but one form.

Every block but scripts and styles goes into the tree. What the contract names by element (menus, headers, footers, sidebars, forms within articles and the like) goes, and so
do plain names of adverts and lists of comments inside an article. Of the rest, a branch goes as a whole if its importance is below ``BRANCH``; of what is left, a
single text goes if its own content importance is below ``TEXT``. A name is a weight, not a verdict:

* outside articles, a named box on a site of few pages has the importance ``PRIOR``, which is too little; on a site of more it has what the tree says;
* either is beaten by the square of the share of a page's text that the box holds, on pages without article or main element: a form or a
  "side-by-side" around nearly everything is the page;
* inside an article a named box stays on a site of few pages, and is for the tree on others;
* an article or main element inside a named box is judged by itself.

Pages of a host with the same longest text count as one, so copies don't make their text look like a frame.
Statistics are grouped and joined by Spark; a page's own blocks are all a task holds.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined by a blank in
the order of the page. Null and empty pages have no text, null urls share a host. Repeated rows count as one page and get the same result; rows with
one id and unlike sources are extracted apart. Other columns pass through, but for those named as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, apart, column, slices, texts_of, with_columns, written

GAMMA = 0.9
#: So many texts that go, with 9 bytes each, are sent to all tasks at most.
MAX_SENT = 500_000
#: The same for boxes with names of frames; and their importance where no other pages tell.
NAMED, PRIOR = 0.5, 0.45
#: What markup says of an element; what is inside a named box, and not named itself, goes with it and is judged as open.
OUT, APART_BY_NAME, BOX, OPEN, ARTICLE_TEXT, WITHIN_NAMED = range(6)
#: By these: the least importance of a branch and of a single text.
BRANCH, TEXT = (0.6, 0.6, 0.6, 0.6, 0.1, 0.6), (0.3, 0.3, 0.3, 0.3, 0.1, 0.3)
#: Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
#: Empty elements that do not end a block.
IN_LINE_VOID = frozenset("area col embed img input param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("nav header footer aside form script style noscript template iframe button select option datalist dialog menu head title textarea object audio video canvas svg math input".split())
ARTICLE = frozenset(("article", "main"))
#: Names that mark adverts and reader comments inside an article, as whole names only.
NAMES_WITHIN = frozenset("ad ads advert adverts advertisement adsbygoogle ad-slot sponsored comments comment-list comments-area comment-form respond disqus_thread".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark frames of a page.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|submenu|sidebar|side|rail|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|replies|responses?|respond|latest|trending|popular|disqus|widgets?|toolbar|pagination|pager|search|form|skip|copyright)(?=$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+>", re.S)
#: An attribute, name and value; a value is taken whole, so nothing inside it is read as a name.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s<>/=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?""")
#: Names that only say what a page has, or lacks, or is filed under.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:with|without|no|has|tag|category)[_-]\S*", re.I)
#: Start tags that end an open paragraph or item of the same name.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements deeper than this keep their name and state, but no path of their own, so that nesting cannot exhaust memory.
DEEPEST = 200


class _Open:
    """An open element, and the node of the tree that it is."""

    __slots__ = ("tag", "path", "state", "named", "children", "shown")

    def __init__(self, tag: str, path: str, state: str, named: bool = False) -> None:
        self.tag, self.path, self.state, self.named, self.children, self.shown = tag, path, state, named, [], False


_STATES = {"out": OUT, "apart": APART_BY_NAME, "box": BOX, "open": OPEN, "main": ARTICLE_TEXT, "in": ARTICLE_TEXT}


def _state(tag: str, raw: str, above: str) -> tuple[str, str, bool]:
    """How the text of an element is settled, its name in the path, and whether it is named itself.

    'out'; 'apart' (by a class name or form, here or above); 'box' (the same inside an article, here only); 'in' an article; 'main'; or 'open'.
    """
    above = "in" if above == "box" else above
    names: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    label = f"{names.get('class', '')} {names.get('id', '')}".strip()
    name = f"{tag}.{' '.join(sorted(label.split()))}" if label else tag
    if above == "out":
        return "out", name, False
    if tag == "body" or tag == "html":
        return above, name, False
    role = names.get("role", "").lower()
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower() or role in ROLES:
        return "out", name, False
    inside = above in ("in", "main")
    words = label.lower().split()
    own = _ABOUT.sub(" ", label)
    framed = NAMES.search(_HEADER.sub(" ", own) if inside else own) is not None
    # one comment is an item of a list of them
    plain = above == "in" and (not NAMES_WITHIN.isdisjoint(words) or tag in ("article", "li") and "comment" in words)
    if tag in ARTICLE or role in ("main", "article"):
        if plain or framed and above in ("apart", "main"):
            return "out", name, False
        return ("in" if above == "in" or tag == "article" or role == "article" else "main"), name, False
    if tag in APART and tag != "form" and not (tag == "header" and inside) or plain or tag == "form" and above == "in":
        return "out", name, False
    if framed or tag == "form":
        return ("box" if above == "in" else "apart"), name, True
    return above, name, False


@dataclass
class Block:
    """A text, the path of its node, and what markup says of it."""

    path: str
    text: str
    state: int


@dataclass
class Node:
    """The paths of the nodes above, the sequences of children that a page shows, and the share of its text that the branch holds (0 with an article)."""

    above: list[str]
    styles: list[str]
    state: int
    share: float = 0.0


def tree_of(source: str) -> tuple[list[Block], dict[str, Node]]:
    """The blocks of a page, in order, and the nodes that they stand in and under, by path."""
    blocks: list[Block] = []
    shown: list[tuple[_Open, list[str]]] = []
    root = _Open("", "", "open")
    stack = [root]
    deep: list[tuple[str, str]] = []  # name and state of the open elements below DEEPEST
    held: Counter[str] = Counter()  # of these, by name
    parts: list[str] = []

    def state_here() -> str:
        return deep[-1][1] if deep else stack[-1].state

    def leave() -> str:
        tag = deep.pop()[0]
        held[tag] -= 1
        return tag

    def flush() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                k = len(stack) - 1
                while k > 0 and stack[k].tag in INLINE:
                    k -= 1
                above = [e for e in stack[: k + 1] if e is root or e.tag not in INLINE]
                for n, e in enumerate(above):
                    if not e.shown:
                        e.shown = True
                        shown.append((e, [x.path for x in above[:n]]))
                # the element's own state may be another than that of its node: markup left open, or elements too deep for a node
                blocks.append(Block(above[-1].path, text, _STATES[state_here()]))
            parts.clear()

    # a tag ends with '>': after the last one all is text, which no search need go through again and again
    at, size = 0, len(source)
    tags_end = source.rfind(">") + 1
    while at < size:
        m = _TAG.search(source, at, tags_end) if at < tags_end else None
        until = m.start() if m else size
        if not m and (comment := source.find("<!--", at)) >= 0:
            until = comment
        if until > at:
            parts.append(source[at:until])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if not inline and tag not in IN_LINE_VOID:
            flush()
        if m[1] or m[4]:
            if held[tag]:
                if not inline or all(t in INLINE for t, _ in takewhile(lambda x: x[0] != tag, reversed(deep))):  # an inline end tag doesn't close blocks
                    while leave() != tag:
                        pass
                continue
            if deep and inline:
                continue
            if any(e.tag == tag for e in stack[1:]):
                if inline and stack[-1].tag != tag and any(e.tag not in INLINE for e in stack[next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) :]):
                    continue  # an inline end tag doesn't close blocks
                deep.clear()
                held.clear()
                while stack.pop().tag != tag:
                    pass
            continue
        raw = m[3] if m[2] else m[6]
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        if deep:
            if not inline and deep[-1][0] == "p" or tag in SELF_CLOSING and deep[-1][0] == tag:
                leave()
        elif tag in SELF_CLOSING or not inline and stack[-1].tag == "p":
            while len(stack) > 1 and stack[-1].tag in INLINE:  # what a paragraph left open ends with it
                if not any(e.tag in SELF_CLOSING for e in stack[1:]):
                    break
                stack.pop()
            if stack[-1].tag == tag and tag in SELF_CLOSING or stack[-1].tag == "p":
                stack.pop()
        if stack[-1].children[-1:] != [tag]:
            stack[-1].children.append(tag)
        state, name, named = _state(tag, raw, state_here())
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if raw.endswith("/") and not inline and tag not in ("p", "div", "li", "article", "main", "section"):
            continue
        if len(stack) < DEEPEST:
            # the state is part of the path, so a node has one
            stack.append(_Open(tag, f"{stack[-1].path}>{name}" + ("" if state == stack[-1].state else f"!{state}"), state, named))
        else:
            deep.append((tag, state))
            held[tag] += 1
    flush()
    nodes: dict[str, Node] = {}
    for e, above in shown:
        node = nodes.setdefault(e.path, Node(above, [], WITHIN_NAMED if e.state == "apart" and not e.named else _STATES[e.state]))
        if (style := ",".join(e.children)) not in node.styles[-8:]:
            node.styles.append(style)
    told = [(b.path, len(b.text)) for b in blocks if b.state > OUT]
    if told and not any(b.state in (BOX, ARTICLE_TEXT) for b in blocks):
        total = sum(n for _, n in told)
        for path, n in told:
            for p in (*nodes[path].above, path):
                nodes[p].share += n / total
    return blocks, nodes


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _parsed(df: DataFrame, source: str) -> DataFrame:
    """``df`` without the source, with ``page`` (fingerprint), ``copy`` (of the longest text), ``blocks`` (node, h, text, state) and ``nodes`` (node, above, style, state, share).

    Texts that markup puts out have no ``text``, as only their fingerprints are needed.
    """
    block = T.StructType([T.StructField("node", T.LongType()), T.StructField("h", T.LongType()), T.StructField("text", T.StringType()), T.StructField("state", T.IntegerType())])
    node = T.StructType([T.StructField("node", T.LongType()), T.StructField("above", T.ArrayType(T.LongType())), T.StructField("style", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("share", T.DoubleType())])
    schema = added(df.schema, ("page", T.LongType()), ("copy", T.LongType()), ("blocks", T.ArrayType(block)), ("nodes", T.ArrayType(node)), drop=[source])
    arrow = to_arrow_schema(schema)

    def number(x: str) -> int:
        return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            sources = texts_of(column(b, source))
            copies, all_blocks, all_nodes = [], [], []
            for s in sources:
                blocks, nodes = tree_of(s)
                of = {p: number(p) for p in nodes}
                likely = [x.text for x in blocks if x.state] or [x.text for x in blocks] or [""]
                copies.append(number(max(likely, key=len)))
                all_blocks.append([{"node": of[x.path], "h": number(x.text), "text": x.text if x.state > OUT else None, "state": x.state} for x in blocks])
                all_nodes.append([{"node": of[p], "above": [of[a] for a in n.above], "style": number("|".join(n.styles)), "state": n.state, "share": n.share} for p, n in nodes.items()])
            new = {"page": pa.array([number(s) for s in sources], pa.int64()), "copy": pa.array(copies, pa.int64())}
            yield with_columns(b, arrow, new | {"blocks": pa.array(all_blocks, arrow.field("blocks").type), "nodes": pa.array(all_nodes, arrow.field("nodes").type)})

    return df.mapInArrow(run, schema)


def importance(pages: DataFrame, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """The site trees, from ``host``, ``copy``, ``blocks`` and ``nodes``.

    site (fingerprint of host and node), m (distinct pages), state, above (sites), presentation, content, share and importance of each
    node; and site, h, state, k (distinct pages) and content (importance) of each text at its node.
    """
    log_m = F.log(F.greatest("m", F.lit(2)))

    def site(node: Column) -> Column:
        return F.xxhash64("host", node)

    # one row for each node and distinct page, then for each style of a node
    nodes = F.transform("nodes", lambda x: F.struct(site(x["node"]).alias("site"), x["style"].alias("style"), x["state"].alias("state"), F.transform(x["above"], site).alias("above"), x["share"].alias("share")))
    styles = pages.select("copy", F.explode(nodes).alias("x")).groupBy("x.site", "copy").agg(F.min("x.style").alias("style"), F.min("x.state").alias("state"), F.first("x.above").alias("above"), F.max("x.share").alias("share"))
    styles = styles.groupBy("site", "style").agg(F.count("*").alias("n"), F.min("state").alias("state"), F.first("above").alias("above"), F.sum("share").alias("share"))
    tree = styles.groupBy("site").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.min("state").alias("state"), F.first("above").alias("above"), F.sum("share").alias("share"))
    tree = tree.select("site", "m", "state", "above", (F.col("share") / F.col("m")).alias("share"), F.when(F.col("m") >= min_pages, (F.log("m") - F.col("s") / F.col("m")) / log_m).otherwise(1.0).alias("presentation"))
    tree = written(tree, "tree")
    texts = F.array_distinct(F.transform("blocks", lambda x: F.struct(site(x["node"]).alias("site"), x["h"].alias("h"), x["state"].alias("state"))))
    texts = pages.select("copy", F.explode(texts).alias("x")).select("x.*", "copy").distinct().groupBy("site", "h", "state").agg(F.count("*").alias("k"))
    own = 1 - F.log("k") / log_m
    texts = texts.join(tree.select("site", "m"), "site").select("site", "h", "state", "k", F.when(F.col("m") >= min_pages, own).otherwise(1.0).alias("content"))
    texts = written(texts, "texts")
    # content importance is carried up: each node's texts count for it and for all nodes above
    sums = texts.groupBy("site").agg(F.count("*").alias("l"), F.sum("content").alias("c")).join(tree, "site")
    branch = sums.select(F.explode(F.array_append("above", F.col("site"))).alias("site"), "l", "c").groupBy("site").agg((F.sum("c") / F.sum("l")).alias("content"))
    tree = tree.join(branch, "site").withColumn("content", F.when(F.col("m") >= min_pages, F.col("content")).otherwise(1.0))
    g = F.when(F.col("state").isin(APART_BY_NAME, BOX), NAMED).otherwise(GAMMA)
    told = F.when(F.col("m") < min_pages, F.when(F.col("state") == APART_BY_NAME, PRIOR).otherwise(1.0)).otherwise((1 - g) * F.col("presentation") + g * F.col("content"))
    return written(tree.withColumn("importance", F.when(F.col("state") == APART_BY_NAME, F.greatest(told, F.round(F.col("share") * F.col("share"), 9))).otherwise(told)).withColumn("known", F.col("m") >= min_pages), "nodes"), texts


def _by_state(values: tuple[float, ...], state: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col(state))


def put_out(tree: DataFrame, texts: DataFrame) -> DataFrame:
    """site, h, state and by_tree (on the word of the site's pages, not of names alone) of the texts that go, but for those that markup alone puts out."""
    low = tree.where((F.col("importance") < _by_state(BRANCH, "state")) & (F.col("state") > OUT)).select(F.col("site").alias("low"), F.col("known").alias("by_tree"), (F.col("state") == APART_BY_NAME).alias("by_name"))
    # a node goes with the branch that it is in, but an article is not bound by the name of what is around it
    reach = tree.select("site", F.col("state").isin(BOX, ARTICLE_TEXT).alias("free"), F.explode(F.array_append("above", F.col("site"))).alias("low"))
    gone = written(reach.join(low, "low").where(~(F.col("free") & F.col("by_name"))).groupBy("site").agg(F.max("by_tree").alias("branch")), "gone")
    marked = texts.where(F.col("state") > OUT).join(gone, "site", "left").withColumn("low", F.col("content") < _by_state(TEXT, "state"))
    return written(marked.where(F.col("branch").isNotNull() | F.col("low")).select("site", "h", "state", (F.coalesce("branch", F.lit(False)) | F.col("low")).alias("by_tree")), "lost")


def _finished(pages: DataFrame, rest: list[str], gone: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``rest``, text, n_chars, out_by_markup and out_by_tree, from ``blocks`` and, aligned with them, the ``keys`` of texts; ``gone``: sorted keys that
    go, and whether by the tree. Without it, ``gone`` and ``by_tree`` are columns with the places of a page's texts that go."""
    new = [("text", T.StringType()), ("n_chars", T.LongType()), ("out_by_markup", T.LongType()), ("out_by_tree", T.LongType())]
    schema = T.StructType([f for f in pages.schema.fields if f.name in rest] + [T.StructField(n, t) for n, t in new])
    arrow = to_arrow_schema(schema)
    shared = pages.sparkSession.sparkContext.broadcast(gone) if gone else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            blocks = column(b, "blocks")
            texts, states = (blocks.flatten().field(n) for n in ("text", "state"))
            texts, states, sizes = texts.to_pylist(), states.to_numpy(), blocks.value_lengths().to_numpy()
            if shared:
                keys, known = column(b, "keys").flatten().to_numpy(), shared.value
                at = np.minimum(np.searchsorted(known[0], keys), max(len(known[0]) - 1, 0))
                lost = known[0][at] == keys if len(known[0]) else np.zeros(len(keys), dtype=bool)
                tree = lost & known[1][at] if len(known[0]) else lost
            else:
                lost, tree = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
                for mask, name in ((lost, "gone"), (tree, "by_tree")):
                    start = 0
                    for places, n in zip(column(b, name).to_pylist(), sizes):
                        mask[start + np.array(places or [], dtype=np.int64)] = True
                        start += n
            out = lost | (states == OUT)
            tree &= states > OUT
            joined, by_markup, by_tree, start = [], [], [], 0
            for n in sizes.tolist():
                end = start + n
                joined.append(" ".join([t for t, x in zip(texts[start:end], out[start:end]) if not x]))
                by_tree.append(int(tree[start:end].sum()))
                by_markup.append(int(out[start:end].sum()) - by_tree[-1])
                start = end
            yield with_columns(b, arrow, {"text": pa.array(joined, pa.string()), "n_chars": pa.array([len(t) for t in joined], pa.int64()), "out_by_markup": pa.array(by_markup, pa.int64()), "out_by_tree": pa.array(by_tree, pa.int64())})

    return pages.mapInArrow(run, schema)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", min_pages: int = 5) -> DataFrame:
    """``df`` without the source, with text (string, '' if none), n_chars, out_by_markup and out_by_tree (long; blocks put out by markup alone, and by the tree).

    The texts that go, by site, are few where sites have frames and many pages; up to ``MAX_SENT`` of them are sent to all tasks, so
    that pages need no shuffle. Where there are more, places are joined instead, with the same result.
    """
    own, name = apart(df, page_id, url, source)
    rest = [f"c{k}" for k, c in enumerate(df.columns) if c.lower() not in (source.lower(), "text", "n_chars", "out_by_markup", "out_by_tree")]
    carried = list(dict.fromkeys([*rest, name[page_id]]))
    parsed = written(_parsed(own.select(*carried, host_of(F.col(name[url])).alias("host"), F.col(name[source]).alias("source")), "source"), "pages")
    lost = put_out(*importance(parsed, min_pages))
    key = lambda site, x: F.xxhash64(site, x["h"], x["state"])
    if lost.count() <= MAX_SENT:
        sent = lost.select(F.xxhash64("site", "h", "state").alias("key"), "by_tree").toArrow().sort_by("key")
        gone = (sent.column("key").to_numpy(), sent.column("by_tree").to_numpy(zero_copy_only=False) if sent.num_rows else np.zeros(0, dtype=bool))
        keys = F.transform("blocks", lambda x: key(F.xxhash64("host", x["node"]), x))
        out = _finished(parsed.select(*rest, "blocks", keys.alias("keys")), rest, gone)
    else:
        keys = F.transform("blocks", lambda x, k: F.struct(F.xxhash64("host", x["node"]).alias("site"), x["h"].alias("h"), x["state"].alias("state"), k.alias("k")))
        keys = parsed.select(F.col(name[page_id]).alias("id"), "host", "page", F.explode(F.filter(keys, lambda x: x["state"] > OUT)).alias("x")).select("id", "host", "page", "x.*")
        # equal rows have equal blocks, so a set is enough
        gone = keys.join(lost, ["site", "h", "state"]).groupBy("id", "host", "page").agg(F.collect_set("k").alias("gone"), F.collect_set(F.when(F.col("by_tree"), F.col("k"))).alias("by_tree"))
        gone = written(gone, "places")
        same = F.col(f"p.{name[page_id]}").eqNullSafe(F.col("g.id")) & (F.col("p.host") == F.col("g.host")) & (F.col("p.page") == F.col("g.page"))
        out = _finished(parsed.alias("p").join(gone.alias("g"), same, "left").select(*(f"p.{c}" for c in rest), "p.blocks", "g.gone", "g.by_tree"), rest, None)
    return out.select(*(F.col(c).alias(df.columns[int(c[1:])]) for c in rest), "text", "n_chars", "out_by_markup", "out_by_tree")
