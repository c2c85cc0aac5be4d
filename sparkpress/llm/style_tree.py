"""Operator 8, HTML extraction: pages pruned by a site style tree.

The pages of one host are merged into a style tree (Yi, Liu and Li 2003).  An
*element node* is a place in the tree; the sequences of children (tag, class and
id) that pages show there are its *styles*; a text is a leaf.  A node's key is a
hash of its way from the root, which begins with the host, so merging the trees
of a host is a count by key and needs no task that sees the whole host.

With m pages at a node, importance is

* presentation, for an element whose styles are used by c_1 ... c_l pages: the
  entropy ``-sum p_i log_m p_i`` of p_i = c_i / m;
* content, for a leaf whose l distinct texts are on c_1 ... c_l pages:
  ``1 - 1/l sum log_m c_i``, a text being spread evenly over its pages;
* 1 where m = 1;
* composite: ``(1 - g^l) * presentation + g^l * sum p_i * (mean composite of style
  i's children)`` with g = ``GAMMA``; a leaf's is its content importance, a
  childless style counts 0.

A composite is a weighted sum over all nodes below, so it is folded by doubling:
after round k every node has the sums of the next 2^k levels, and a pointer to the
node 2^k levels above.  The rounds grow with the logarithm of the depth, and pages
may be nested to any depth.

A branch is noise if its node and all nodes below have a composite importance
under ``THRESHOLD`` (a mean alone would drop a body for its menus).  A second pass
over the pages drops these branches and joins the texts that are left.  The keys of
such nodes are broadcast if they are at most ``BROADCAST_KEYS``; beyond that
each page gets its own keys by a join.

Result: (page_id, url, text, nodes, dropped): nodes of the page, and how many of
them were in dropped branches.  Scripts, styles, comments, noscript, templates and
the head have no nodes; texts of block elements are on lines of their own.

Defined cases: a null html has a null text and 0 nodes; a null or host-less url
belongs to the host ''; broken markup is closed where a later tag implies it, a head
without an end tag at the first element or text that belongs to a body, a script or
style without one at the end of the page; a very long or deep page is handled like
any other; branches of equal importance share their fate; repeated rows
count, and come out, as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textkernel as K

GAMMA, THRESHOLD = 0.9, 0.2
BROADCAST_KEYS = 2_000_000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<[!?/][^>]*>|([^<]+|<)""", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd label mark q s samp small span strike strong sub sup tt u var".split())
#: Elements without nodes, and those that a head may hold.
_HIDDEN = frozenset("head noscript template".split())
_OF_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_MASK = (1 << 64) - 1


def _child(parent: int, number: int) -> int:
    h = (parent ^ (number * 0x9E3779B97F4A7C15)) & _MASK
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) & _MASK
    return h ^ (h >> 32)


class Node:
    __slots__ = ("children", "key", "sign", "style", "tag", "text")

    def __init__(self, tag: str, sign: int, text: str | None = None):
        self.tag, self.sign, self.text, self.children = tag, sign, text, []


def parse(source: str, signs: dict[str, int]) -> Node:
    """The page's tree; signs keeps the hashes of tags with their classes."""
    root = Node("", 0)
    stack, open_, head = [root], Counter(), 0  # head: place of an open head on the stack

    def cut(k: int) -> None:
        nonlocal head
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]
        if head >= k:
            head = 0

    for token in _TOKEN.finditer(source):
        _, close, tag, rest, text = token.groups()
        if text is not None:
            text = " ".join(entities.unescape(text).split())
            if text:
                if head and len(stack) == head + 1:
                    cut(head)
                stack[-1].children.append(Node("", 1, text))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if open_[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if head and tag not in _OF_HEAD and not open_["noscript"] and not open_["template"]:
            cut(head)
        if tag not in _INLINE and tag != "br":
            while stack[-1].tag in _INLINE or (stack[-1].tag == "p" and tag not in _VOID):
                cut(len(stack) - 1)
            if stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                cut(len(stack) - 1)
        name = tag + "".join(sorted(v.strip("\"'") for v in _CLASS.findall(rest))) if rest else tag
        sign = signs.get(name)
        if sign is None:
            sign = signs[name] = xxhash.xxh64_intdigest(name)
        node = Node(tag, sign)
        if tag not in _HIDDEN:
            stack[-1].children.append(node)
        if tag not in _VOID and not rest.endswith("/"):
            if tag == "head" and not head:
                head = len(stack)
            stack.append(node)
            open_[tag] += 1
    return root


def mark(root: Node, host: int) -> list[tuple[int, int, int, int, bool]]:
    """(key, style or text, style of the parent, depth, leaf) of each node; sets the nodes' keys."""
    rows = []
    todo = [(root, host, 0, 0)]
    while todo:
        node, key, above, depth = todo.pop()
        node.key = key
        if node.text is not None:
            rows.append((key, xxhash.xxh64_intdigest(node.text), above, depth, True))
            continue
        style = key
        for child in node.children:
            style = _child(style, child.sign)
        rows.append((key, style, above, depth, False))
        for i, child in enumerate(node.children):
            todo.append((child, _child(style, i + 1), style, depth + 1))
    return rows


def extract(root: Node, low) -> tuple[str, int, int]:
    """(text, nodes, nodes in dropped branches) of a marked tree; low holds the keys of unimportant nodes."""
    out: list[str] = []
    nodes = dropped = 0
    todo: list[tuple[Node | None, bool]] = [(root, False)]  # None: a block ends; True: inside a dropped branch
    while todo:
        node, gone = todo.pop()
        if node is None:
            out.append("\n")
            continue
        gone = gone or node.key in low
        nodes, dropped = nodes + 1, dropped + gone
        if not gone and node.text is not None:
            out.append(node.text)
        elif not gone and node.tag not in _INLINE:
            out.append("\n")
            todo.append((None, False))
        todo += [(child, gone) for child in reversed(node.children)]
    lines = " ".join(out).split("\n")
    return "\n".join(line for line in (line.strip() for line in lines) if line), nodes, dropped


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _occurrences(digest: bool):
    names = ["key", "style", "above", "depth", "leaf"] + ["digest"] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs: dict[str, int] = {}
        for batch in batches:
            hosts, pages, digests = (batch.column(c) for c in ("host", "html", "digest"))
            for s in range(0, batch.num_rows, 500):
                rows, owners = [], []
                for host, page, d in zip(*(c.slice(s, 500).to_pylist() for c in (hosts, pages, digests))):
                    if page is not None:
                        found = mark(parse(page, signs), xxhash.xxh64_intdigest(host))
                        rows += found
                        owners += [d] * len(found)
                columns = list(zip(*rows)) or [()] * 5
                numbers = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.bool_()), *([pa.array(owners, pa.int64())] if digest else [])], names)

    return run


def importance(occurrences: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(key, composite, highest) of every node of the style trees, highest being the greatest composite of its branch, from (key, style, above, depth, leaf) of every node of every page."""
    styles = storage.written(occurrences.groupBy("key", "style").agg(F.count(F.lit(1)).alias("c"), F.min("above").alias("above"), F.min("depth").alias("depth"), F.max("leaf").alias("leaf")), "styles")
    log_m = F.log("m")
    node = styles.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum(F.log("c")).alias("logc"), F.min("above").alias("above"), F.min("depth").alias("depth"), F.max("leaf").alias("leaf"))
    own = F.when(F.col("m") == 1, 1.0).when(F.col("leaf"), 1 - F.col("logc") / F.col("l") / log_m).otherwise((log_m - F.col("clogc") / F.col("m")) / log_m)
    share = F.when(F.col("leaf"), 0.0).otherwise(F.pow(F.lit(gamma), F.col("l")))  # of what is below, in a node's composite
    node = storage.written(node.select("key", "above", "m", share.alias("share"), ((1 - share) * own).alias("c")), "nodes")
    # each node's parent, and its weight there: its style's share of pages, over the children of that style
    siblings = node.groupBy(F.col("above").alias("style")).agg(F.count(F.lit(1)).alias("k"))
    weights = styles.where("NOT leaf").join(siblings, "style").join(node.select("key", "m", "share"), "key").select(F.col("style").alias("above"), F.col("key").alias("up"), (F.col("share") * F.col("c") / F.col("m") / F.col("k")).alias("w"))
    pointers = storage.written(node.join(weights, "above").select("key", "up", "w"), "pointers")
    composite, levels = node.select("key", "c"), []
    while not pointers.isEmpty():
        levels.append(pointers)
        below = pointers.join(composite, "key").groupBy(F.col("up").alias("key")).agg(F.sum(F.col("w") * F.col("c")).alias("more"))
        composite = storage.written(composite.join(below, "key", "left").select("key", (F.col("c") + F.coalesce("more", F.lit(0.0))).alias("c")), "composite")
        above = pointers.select(F.col("key").alias("up"), F.col("up").alias("upper"), F.col("w").alias("v"))
        pointers = storage.written(pointers.join(above, "up").select("key", F.col("upper").alias("up"), (F.col("w") * F.col("v")).alias("w")), "pointers")
    highest = composite.select("key", F.col("c").alias("h"))
    for pointers in levels:
        below = pointers.join(highest, "key").groupBy(F.col("up").alias("key")).agg(F.max("h").alias("more"))
        highest = storage.written(highest.join(below, "key", "left").select("key", F.greatest("h", "more").alias("h")), "highest")
    return composite.join(highest, "key").select("key", F.col("c").alias("composite"), F.col("h").alias("highest"))


def extract_pages(pages: DataFrame, gamma: float = GAMMA, threshold: float = THRESHOLD, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(page_id, url, text, nodes, dropped) for every row of pages."""
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).withColumn("digest", F.xxhash64("host", "html"))
    kind = "key long, style long, above long, depth int, leaf boolean"
    low = storage.written(importance(given.mapInArrow(_occurrences(False), kind), gamma).where(F.col("highest") < threshold).select("key"), "low")
    names = ["page_id", "url", "text", "nodes", "dropped"]
    sent = spark.sparkContext.broadcast(np.sort(low.toArrow()["key"].to_numpy())) if low.count() <= broadcast_keys else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs: dict[str, int] = {}
        common = frozenset(sent.value.view(np.uint64).tolist()) if sent is not None else None
        for batch in batches:
            own = batch.column("low").to_pylist() if common is None else [None] * batch.num_rows
            found = []
            for host, page, keys in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), own):
                if page is None:
                    found.append((None, 0, 0))
                    continue
                root = parse(page, signs)
                mark(root, xxhash.xxh64_intdigest(host))
                found.append(extract(root, common if common is not None else {k & _MASK for k in keys or ()}))
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64())))], names)
        del common
        K.release()

    if sent is None:
        own = given.mapInArrow(_occurrences(True), kind + ", digest long").select("digest", "key").join(low, "key").groupBy("digest").agg(F.collect_set("key").alias("low"))
        given = given.join(own, "digest", "left")
    return given.mapInArrow(run, "page_id long, url string, text string, nodes long, dropped long")
