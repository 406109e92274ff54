"""Operator 8: main text of pages by site style trees and entropy-based node importance."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, texts_to_python
from .line_dedup import host_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?][^>]*>", re.S | re.I)
_LOOK = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code del em font i img ins kbd label mark q s samp small span strong sub sup tt u var wbr".split())
#: Elements that a start tag of the key ends, where they are open within the nearest block.
_CLOSES = {"p": {"p"}, "li": {"p", "li"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}} | {k: {"p"} for k in "article aside blockquote div footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that only go with what holds them: the page itself, and parts of a line of text.
_KEPT = _INLINE | {"#", "html", "head", "body"}
_BLANK = re.compile(r"\s+")


class Node:
    """Element: its look (tag with class and id), its key in the host's style tree and its children, which are elements or text."""

    __slots__ = ("tag", "look", "children", "key")

    def __init__(self, tag: str, look: str) -> None:
        self.tag, self.look, self.children, self.key = tag, look, [], 0


def parse(page: str | None) -> Node:
    """A page's DOM. Never fails: what isn't closed ends with the page, and stray end tags are passed over. Nesting may have any depth."""
    root = Node("#", "#")
    stack = [root]
    still_open: dict[str, int] = {}
    last, page = 0, page or ""

    def close() -> str:
        tag = stack.pop().tag
        still_open[tag] -= 1
        return tag

    def text(t: str) -> None:
        if t and not t.isspace():
            stack[-1].children.append(_BLANK.sub(" ", html_lib.unescape(t) if "&" in t else t))

    for m in _TAG.finditer(page):
        text(page[last : m.start()])
        last = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if still_open.get(tag):
                while close() != tag:
                    pass
            continue
        ends = _CLOSES.get(tag)
        while ends and len(stack) > 1 and (stack[-1].tag in ends or (stack[-1].tag in _INLINE and len(stack) > 2 and any(n.tag in ends for n in stack[-4:]))):
            close()
        node = Node(tag, tag + "".join(f".{''.join(y)}" for y in _LOOK.findall(m[4])) if m[4] else tag)
        stack[-1].children.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append(node)
            still_open[tag] = still_open.get(tag, 0) + 1
    text(page[last:])
    return root


def _key(*parts) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


#: Depth from which a branch is composed in one go; above, a level is a join, so that no task holds a whole host.
DEEP = 64


def walk(root: Node, host: str, deep: int = DEEP) -> Iterator[tuple[int, int, int, int, int, int, Node]]:
    """(element node, style, parent style, depth, branch, number of child elements, Node) of every node of the page in its host's style tree, top down.

    The style of an element is the sequence of its children's looks; its children hang below that style by their
    place in it, so pages share a branch as far as their structure is the same. branch is the node of depth ``deep`` that
    it hangs below, 0 above that depth. Each Node gets its key.
    """
    todo = [(_key(host, root.look), 0, 0, 0, root)]
    while todo:
        e, up, depth, branch, node = todo.pop()
        branch = e if depth == deep else branch
        node.key = e
        kids = [c for c in node.children if isinstance(c, Node)]
        style = _key(e, *(c.look if isinstance(c, Node) else "#text" for c in node.children))
        yield e, style, up, depth, branch, len(kids), node
        todo += [(_key(style, i, c.look), style, depth + 1, branch, c) for i, c in enumerate(kids)]


def features(node: Node) -> dict[int, int]:
    """Content features of a node with their counts: its own texts, trimmed and lower-cased."""
    out: dict[int, int] = {}
    for c in node.children:
        if not isinstance(c, Node):
            k = _key(c.strip().lower())
            out[k] = out.get(k, 0) + 1
    return out


def observe(pages: DataFrame, deep: int = DEEP) -> DataFrame:
    """(host, e, up, depth, branch, kind, s, kids, n, q): pages (host, html) as counts of styles (kind 0) and features (kind 1) for each element node.

    n is the number of pages with a style or the count of a feature, q the sum of c log c over pages. Partial sums are made in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        names = ["host", "e", "up", "depth", "branch", "kind", "s", "kids", "n", "q"]

        def out() -> pa.RecordBatch:
            cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e, style, up, depth, branch, kids, node in walk(parse(page), host, deep):
                    x = held.setdefault((host, e, up, depth, branch, 0, style, kids), [0, 0.0])
                    x[0] += 1
                    for f, c in features(node).items():
                        x = held.setdefault((host, e, up, depth, branch, 1, f, 0), [0, 0.0])
                        x[0] += c
                        x[1] += c * math.log(c)
                if len(held) > 200_000:
                    yield out()
        if held:
            yield out()

    found = texts_to_python(pages).mapInArrow(run, "host string, e long, up long, depth int, branch long, kind byte, s long, kids int, n long, q double")
    return found.groupBy("host", "e", "up", "depth", "branch", "kind", "s", "kids").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))


def _style_tree(pages: DataFrame, least_pages: int, deep: int) -> DataFrame:
    """(host, e, up, depth, branch, m, content, styles) of the element nodes that at least two pages of a host have, on hosts of ``least_pages`` or more.

    m is the number of pages, content 1 less the mean entropy of the texts (null without any), styles the (s, n, kids) of the node.
    """
    counts = observe(pages, deep)
    m = F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m")
    h = F.sum(F.when(F.col("kind") == 1, F.log("n") - F.col("q") / F.col("n"))).alias("h")
    number = F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("l")
    styles = F.collect_list(F.when(F.col("kind") == 0, F.struct("s", "n", "kids"))).alias("styles")
    nodes = counts.groupBy("host", "e", "up", "depth", "branch").agg(m, h, number, styles).where("m > 1")
    totals = pages.groupBy("host").count().where(F.col("count") >= least_pages).select("host")
    h = F.least(F.col("h") / F.log("m"), F.col("l"))
    return nodes.join(totals, "host", "left_semi").select("host", "e", "up", "depth", "branch", "m", F.when(F.col("l") > 0, 1 - h / F.col("l")).alias("content"), "styles")


def _level(nodes: DataFrame, below: DataFrame | None, gamma: float) -> DataFrame:
    """(host, e, up, importance, top) of nodes of one depth, given those of the next deeper one; a child that only one page has counts 1."""
    x = nodes.select("host", "e", "up", "m", "content", F.explode("styles").alias("x")).select("host", "e", "up", "m", "content", "x.s", "x.n", "x.kids")
    if below is None:
        x = x.withColumns({"got": F.lit(0.0), "known": F.lit(0), "most": F.lit(None).cast("double")})
    else:
        kids = below.groupBy(F.col("up").alias("s")).agg(F.sum("importance").alias("got"), F.count("*").alias("known"), F.max("top").alias("most"))
        x = x.join(kids, "s", "left").fillna({"got": 0.0, "known": 0})
    lone = F.greatest(F.col("kids") - F.col("known"), F.lit(0))
    own_text = F.col("content").isNotNull().cast("int")
    parts = F.col("known") + lone + own_text
    mean = F.when(parts > 0, (F.col("got") + lone + F.coalesce("content", F.lit(0.0))) / parts).otherwise(F.coalesce("content", F.lit(0.0)))
    p = F.col("n") / F.col("m")
    x = x.groupBy("host", "e", "up", "m", "content").agg(F.max("kids").alias("kids"), F.count("*").alias("styles"), (-F.sum(p * F.log(p)) / F.log("m")).alias("own"), F.sum(p * mean).alias("inner"), F.max(F.when(lone > 0, F.lit(1.0)).otherwise(F.col("most"))).alias("most"))
    weight = F.pow(F.lit(gamma), F.col("styles"))
    value = F.when(F.col("kids") == 0, F.coalesce("content", F.lit(0.0))).otherwise((1 - weight) * F.col("own") + weight * F.col("inner"))
    return x.select("host", "e", "up", value.alias("importance"), F.greatest(value, F.col("most"), F.col("content")).alias("top"))


def _compose(rows: dict, gamma: float) -> dict[int, tuple[float, float]]:
    """(importance, top) of the nodes of some branches, from the leaves up: what :func:`_level` does, for any depth at once."""
    below: dict[int, list] = {}
    for e, r in rows.items():
        below.setdefault(r["up"], []).append(e)
    out: dict[int, tuple[float, float]] = {}
    for e in sorted(rows, key=lambda e: -rows[e]["depth"]):
        r = rows[e]
        content, m, inner, own, top = r["content"], r["m"], 0.0, 0.0, 0.0
        for x in r["styles"]:
            known = [out[k] for k in below.get(x["s"], ())]
            vals = [v for v, _ in known] + [1.0] * max(0, x["kids"] - len(known))
            top = max([top, *(t for _, t in known), 1.0 if x["kids"] > len(known) else 0.0])
            if content is not None:
                vals.append(content)
            p = x["n"] / m
            own -= p * math.log(p) / math.log(m)
            inner += p * (sum(vals) / len(vals) if vals else content or 0.0)
        weight = gamma ** len(r["styles"])
        value = (1 - weight) * own + weight * inner if any(x["kids"] for x in r["styles"]) else content or 0.0
        out[e] = value, max(value, top, content or 0.0)
    return out


def importance(pages: DataFrame, least_pages: int, gamma: float, deep: int = DEEP) -> DataFrame:
    """(host, e, importance, top) of every element node that at least two pages of a host have, on hosts of ``least_pages`` or more.

    top is the greatest importance of the node, its texts and all that hangs below it. Levels are composed from the deepest up,
    each by one join of a level with the next; only what is nested ``deep`` times and more is taken branch by branch.
    """
    nodes = cut(_style_tree(pages, least_pages, deep))
    deepest = nodes.agg(F.max("depth")).first()[0]
    done, below = None, None
    if deepest is not None and deepest >= deep:
        below = done = cut(_deep(nodes.where(F.col("depth") >= deep), gamma))
        below = below.where(F.col("depth") == deep)
    for d in range(min(deep - 1, -1 if deepest is None else deepest), -1, -1):
        below = cut(_level(nodes.where(F.col("depth") == d), below, gamma))
        done = below if done is None else done.unionByName(below, allowMissingColumns=True)
    if done is None:
        done = nodes.select("host", "e", F.lit(0.0).alias("importance"), F.lit(0.0).alias("top"))
    return done.select("host", "e", "importance", "top")


def _deep(nodes: DataFrame, gamma: float) -> DataFrame:
    def whole(t: pa.Table) -> pa.Table:
        rows = {r["e"]: r for r in t.to_pylist()}
        got = _compose(rows, gamma)
        cols = [[r[k] for r in rows.values()] for k in ("host", "e", "up", "depth")] + [[got[e][k] for e in rows] for k in (0, 1)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "e", "up", "depth", "importance", "top"])

    return nodes.groupBy("branch").applyInArrow(whole, "host string, e long, up long, depth int, importance double, top double")


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, Node):
                return True
            todo.append(c)
    return False


def render(root: Node, drop: set[int]) -> tuple[str, int]:
    """The text of a page whose nodes have their keys, without the branches in ``drop``: one line for each block, and the number of branches with text that are removed."""
    lines: list[str] = []
    line: list[str] = []
    removed = 0

    def end() -> None:
        t = _BLANK.sub(" ", "".join(line)).strip()
        line.clear()
        if t:
            lines.append(t)

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.key in drop and x.tag not in _KEPT:
            removed += _has_text(x)
        elif x.tag in _INLINE:
            todo += reversed(x.children)
        else:
            end()
            todo += [None, *reversed(x.children)]
    end()
    return "\n".join(lines), removed


def extract(pages: DataFrame, threshold: float = 0.4, gamma: float = 0.9, least_pages: int = 5, page_id: str = "page_id", url: str = "url", html: str = "html", most: int = 2_000_000) -> DataFrame:
    """(page_id, host, text, n_removed) of every page: its text without the branches of low importance in its host's style tree.

    An element node on m pages is as important as its presentation varies: the entropy, to the base m, of its styles (sequences of
    child looks), blended by ``gamma`` to the number of styles with the mean importance of what hangs below. The content of a
    node counts 1 less the mean entropy of its texts over the pages, so a text that all pages share counts 0 and one of
    a single page counts 1. A branch goes if its top and all that hangs below it, on whatever page, are below ``threshold``;
    nodes of one page, and hosts of fewer than ``least_pages`` pages, stay whole; html, head, body and inline elements
    (links, bold text and so on) only go with the block that holds them. Titles, being in head, are content too.

    Text is put out a line for each block. A null host is the host ''. Null and empty pages give '' and take part as empty
    pages. Broken HTML is read as far as it goes, nested to any depth. Repeated rows are pages of their own, and copies make their own
    content less important. Other columns are ignored. An empty table gives no rows. The keys to remove, 8 bytes each, are
    broadcast up to ``most`` of them; beyond, the keys of each different page are joined with them, and a page gets its own.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    low = cut(importance(rows.select("host", "html"), least_pages, gamma).where(F.col("top") < threshold).select("e"))
    kind = rows.schema["page_id"].dataType.simpleString()
    small = low.limit(most + 1).count() <= most
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(low.toArrow().column("e").to_numpy()) if small else None)
    if not small:
        rows = _with_drops(rows, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            drops = b.column(3).to_pylist() if shared.value is None else [None] * b.num_rows
            for host, page, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), drops, strict=True):
                root = parse(page)
                keys = np.array([x[0] for x in walk(root, host)], np.int64)
                if shared.value is not None and len(shared.value):
                    drop = keys[shared.value[np.minimum(np.searchsorted(shared.value, keys), len(shared.value) - 1)] == keys].tolist()
                t, n = render(root, set(drop or ()))
                texts.append(t)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], ["page_id", "host", "text", "n_removed"])

    return texts_to_python(rows).mapInArrow(run, f"page_id {kind}, host string, text string, n_removed int")


def _with_drops(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows`` (page_id, host, html) with ``drop``, those keys of the page that are in ``low``; equal pages are looked up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, keys = [], []
            for k, host, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = [x[0] for x in walk(parse(page), host)]
                of += [k] * len(mine)
                keys += mine
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(keys, pa.int64())], ["page", "e"])

    keyed = rows.withColumn("page", F.md5(F.concat_ws("\x1f", "host", F.coalesce("html", F.lit(""))).cast("binary")))
    found = keyed.select("page", "host", "html").dropDuplicates(["page"]).mapInArrow(run, "page string, e long")
    drops = found.join(low, "e", "left_semi").groupBy("page").agg(F.collect_set("e").alias("drop"))
    return keyed.join(drops, "page", "left").select("page_id", "host", "html", "drop")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
