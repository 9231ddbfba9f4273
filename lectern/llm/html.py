"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. An element node is a path of block elements, each with its tag and names
(long numbers in names are alike); elements deeper than DEPTH belong to their ancestor there. A page's style at a node is
the order in which kinds of children first come: block elements, inline and void elements, text. Of m distinct pages
that have a node, p_i m have its i-th of l styles there:

    node = - sum p_i log_m p_i                                 entropy of presentation
    content = 1 - sum k log_m k / sum k                        over text blocks, each on k of the m pages
    composite = (1 - GAMMA^l) node + GAMMA^l sum p_i mean(composites of the style's block children, content)

and all are 1 where m is 1. Few pages say little, so the lack of importance that a node shows counts for
(m - 1) / (m - 1 + FEW). A branch is as important as the most important composite or content in it, so a node of
little importance that holds the article stays and its other branches go.

Markup is a prior: it is added to a branch's importance, and what stays under KEEP goes. An <article> or <main>, or an
element named like one, raises what is in it and lowers what is beside it; menus, forms, headers, footers, notices and
the like, by element, role or name, are lowered to nothing. A single block that half of a node's pages or more repeat
is judged by its own entropy in the same way. Copies of a page count once.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, map_chunks, table

#: What importance and prior must come to; the weight of children; pages whose evidence counts half; depth of the tree.
KEEP, GAMMA, FEW, DEPTH = 0.5, 0.9, 3, 64
#: Priors: in an <article> or <main>; in an element named like one; beside either; presentation by its markup.
INSIDE, NAMED, BESIDE, PRESENTATION = 0.35, 0.1, -0.6, -1.0
#: A block that this share of a node's pages repeat is judged by itself.
REPEATED = 0.5
#: Branches and blocks of little importance that are sent to every task at most; more are joined to the pages that have them.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S
)
#: Where no tag can end any more.
_TAIL = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<|(?!)()()", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME, _NUMBER = re.compile(r"[a-z]+"), re.compile(r"\d{3,}")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "noframes", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_GONE = set("nav footer aside form button select input dialog menu head object canvas audio video map applet".split())
_GONE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_GONE_NAMES = set(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets topbar".split()
)
_MAIN_NAMES = set("article articlebody content main maincontent post postbody entry story".split())
#: Parts of a name that say nothing by themselves: a name is of presentation if all its other parts are.
_PLAIN_NAMES = _MAIN_NAMES | set(
    "a area bar block body bottom box center col column container global group header holder home inner item items l left links list main outer page "
    "panel primary r right row secondary section site sticky the top unit wrap wrapper zone".split()
)
#: A start tag ends open elements of these kinds, up to the ones that hold them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_P_STOPS = ("article", "section", "div", "table", "td", "th", "button", "body")
_INLINE_STOPS = ("article", "td", "table")


@dataclass
class Page:
    """Blocks of a page in order: text, path, whether markup calls it presentation, level of content markup (2 in an
    article or main, 1 in an element named like one, 0 elsewhere). And its nodes by path: ancestors, and kinds of children in order."""

    blocks: list[tuple[str, int, bool, int]] = field(default_factory=list)
    chains: dict[int, tuple[int, ...]] = field(default_factory=lambda: {0: (0,)})
    kinds: dict[int, dict] = field(default_factory=lambda: defaultdict(dict))


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _presentation(tag: str, names: list[list[str]], attrs: dict, level: int) -> bool:
    role = attrs.get("role", "").lower()
    named = any(not _GONE_NAMES.isdisjoint(n) and _GONE_NAMES.union(_PLAIN_NAMES).issuperset(n) for n in names)
    return (
        tag in _GONE
        or role in _GONE_ROLES
        or named and (tag not in ("html", "body", "article", "main") or any("comment" in n for n in names))
        or tag == "header" and level < 2
        or "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    )


def parse(source: str | None) -> Page:
    """The page's blocks and nodes, in time linear in its length."""
    page = Page()
    source = source or ""
    # tag, path, presentation, level, index of the nearest block element
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
    where: dict[str, list[int]] = defaultdict(list)  # of every tag, its open elements
    chain: list[int] = [0]
    held: list[str] = []
    last_tag = source.rfind(">")

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            _, path, gone, level, _ = stack[stack[-1][4]]
            page.blocks.append((text, path, gone, level))
            page.kinds[path][""] = None

    def close(tags: tuple, stops: tuple = ()) -> None:
        nonlocal deep
        k = max((where[t][-1] for t in tags if where[t]), default=0)
        if not k or any(where[t] and where[t][-1] > k for t in stops):
            return
        if stack[-1][4] >= k:
            flush()
        for x in stack[k:]:
            where[x[0]].pop()
            deep -= x[0] not in _INLINE
        del stack[k:], chain[min(deep, DEPTH - 1) + 1 :]

    deep = at = 0
    while m := (_TOKEN if at <= last_tag else _TAIL).match(source, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            # an inline element of presentation has its words inside a block that may be none
            if (token[0] != "<" or token == "<") and stack[-1][2] == stack[stack[-1][4]][2]:
                held.append(entities.unescape(token))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not where["p"]:
                flush()
            close((tag,), _INLINE_STOPS if tag in _INLINE or tag == "p" else ())
            continue
        if tag in _RAW:
            if tag not in _INLINE:
                flush()
            end = _RAW_END[tag].search(source, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else len(source)
            continue
        if tag == "br" or tag == "hr":
            held.append(" ")
        if where["head"] and tag not in _VOID:  # what is seen cannot be in a head
            close(("head",))
        if tag not in _INLINE:
            if tag != "br":
                close(("p",), _P_STOPS)
                flush()
            if tag in _ENDS:
                close(*_ENDS[tag])
        _, path, gone, level, owner = stack[-1]
        if tag in _VOID or m[3].endswith("/") and tag in ("embed", "image"):
            page.kinds[path][tag] = None
            continue
        attrs = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip() else {}
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split() if attrs else []
        names = [_NAME.findall(n) for n in named]
        gone = gone or _presentation(tag, names, attrs, level)
        if tag in ("article", "main") or attrs.get("role", "").lower() == "main" or "articleBody" in attrs.get("itemprop", ""):
            level = 2
        elif tag in ("div", "section") and level < 1 and any(len(n) == 1 and n[0] in _MAIN_NAMES or len(n) == 2 and "".join(n) in _MAIN_NAMES for n in names):
            level = 1
        where[tag].append(len(stack))
        if tag in _INLINE:
            page.kinds[path][tag] = None
            stack.append((tag, path, gone, level, owner))
            continue
        deep += 1
        if deep < DEPTH:
            own = xxhash.xxh3_64_intdigest(f"{path}/{tag}.{_NUMBER.sub('0', '.'.join(named))}") >> 1
            page.kinds[path][own] = None
            chain.append(own)
            if own not in page.chains:
                page.chains[own] = tuple(chain)
                page.kinds[own]  # a node without children has a style too
            path = own
        stack.append((tag, path, gone, level, len(stack)))
    flush()
    return page


_RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*>", re.I) for tag in _RAW}


def _feature(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def main_text(page: Page, nodes: Mapping[int, float] = MappingProxyType({}), blocks: Mapping[tuple[int, int], float] = MappingProxyType({}), markup: bool = True) -> str:
    """The text of the blocks whose branch (by path) and own importance (by path and feature; 1 where nothing is known)
    comes to KEEP with markup's prior, or, without markup, alone."""
    level = max((b[3] for b in page.blocks if not b[2]), default=0) if markup else 0
    out = []
    for text, path, gone, own in page.blocks:
        prior = 0.0 if not markup else PRESENTATION if gone else 0.0 if not level else BESIDE if own < level else INSIDE if level == 2 else NAMED
        if min(nodes.get(path, 1.0), blocks.get((path, _feature(text)), 1.0) if blocks else 1.0) + prior >= KEEP:
            out.append(text)
    return " ".join(out)


_STATS = "host string, path long, kind int, value long, size int, siblings int, chain array<long>, page long"


def _page_rows(url: str | None, source: str | None) -> set[tuple]:
    """Rows of _STATS. Kind 0: a node's style, its number of children that have importance, how many the parent has, and
    whether text is among them, in chain; kind 1: a block; kind 2: a node's ancestors, of no page."""
    own, page, mark = host(url), parse(source), xxhash.xxh3_64_intdigest(source or "") >> 1
    heavy = {p: sum(k == "" or isinstance(k, int) for k in kinds) for p, kinds in page.kinds.items()}
    rows: set[tuple] = set()
    for path, chain in page.chains.items():
        kinds = page.kinds[path]
        style = xxhash.xxh3_64_intdigest(repr(list(kinds))) >> 1
        rows.add((own, path, 0, style, heavy.get(path, 0), heavy[chain[-2]] if len(chain) > 1 else 1, (int("" in kinds),), mark))
        rows.add((own, path, 2, 0, 0, 0, chain, 0))
    rows.update((own, path, 1, _feature(text), 0, 0, None, mark) for text, path, _, _ in page.blocks)
    return rows


def _known(importance: Column, pages: Column) -> Column:
    """Importance as far as so many pages show it."""
    return 1 - (1 - importance) * (pages - 1) / (pages - 1 + FEW)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: host, path, pages (distinct pages of the host with the node), composite, content (null without text) and
    importance, of the node's branch. And blocks that REPEATED or more of a node's pages have: host, path, feature,
    importance. Counts are added up before they are dealt out. What is joined and shuffled are distinct nodes of a host,
    each with its ancestors, DEPTH at most, so no host is one task's."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: set[tuple] = set()
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            rows |= _page_rows(url, source)
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        names = ["host", "path", "kind", "value", "size", "siblings", "chain", "page"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    seen = map_chunks(pages.select("url", "html"), run, _STATS).distinct()
    k = F.count(F.lit(1)).alias("k")
    counts = cut(seen.groupBy("host", "path", "kind", "value", "size", "chain").agg(k, F.sum(F.lit(1.0) / F.greatest("siblings", F.lit(1))).alias("share")), "counts")
    style, block, kc = F.col("kind") == 0, F.col("kind") == 1, F.col("k")
    nodes = counts.where("kind < 2").groupBy("host", "path").agg(
        F.sum(F.when(style, kc)).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, kc * F.log(kc))).alias("spread"),
        F.sum(F.when(style, F.col("share"))).alias("share"),
        F.sum(F.when(style & (F.get("chain", F.lit(0)) == 1), kc / F.col("size"))).alias("texts"),
        F.sum(F.when(block, kc * F.log(kc))).alias("block_spread"),
        F.sum(F.when(block, kc)).alias("blocks"),
    )
    m = F.col("pages")
    even = lambda spread, of: F.when(m > 1, 1 - spread / (of * F.log(m))).otherwise(1.0)
    down = F.pow(F.lit(GAMMA), "styles")
    nodes = nodes.withColumn("content", F.when(F.col("blocks") > 0, _known(even(F.col("block_spread"), F.col("blocks")), m)))
    own = (1 - down) * _known(even(F.col("spread"), m), m) + down * F.coalesce(F.col("texts"), F.lit(0.0)) / m * F.coalesce("content", F.lit(0.0))
    nodes = nodes.select("host", "path", "pages", "content", "share", (down / m).alias("down"), own.alias("own"))
    ancestors = counts.where("kind = 2").select("host", "path", "chain")
    # a child's weight in its parent: how much the parent passes up, times the child's share of its pages' children
    nodes = cut(nodes.join(ancestors, ["host", "path"]), "nodes")
    above = nodes.select("host", F.col("path").alias("_parent"), F.col("down").alias("_down"))
    parent = F.get("chain", F.size("chain") - 2)
    weight = F.coalesce(F.col("share") * F.col("_down"), F.lit(1.0))
    nodes = nodes.withColumn("_parent", parent).join(above, ["host", "_parent"], "left").withColumn("weight", weight)
    nodes = cut(nodes.select("host", "path", "pages", "content", "own", "weight", "chain"), "weights")
    weights = nodes.select("host", F.col("path").alias("at"), "weight")
    steps = nodes.select("host", "path", "own", F.posexplode("chain").alias("pos", "at")).join(weights, ["host", "at"])
    steps = steps.groupBy("host", "path", "own").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "weight"))).alias("steps"))
    # what a node gives each of its ancestors: its own part times the weights on the way, its own included
    size = F.size("steps")
    passed = F.aggregate(
        F.reverse("steps"),
        F.struct(F.col("own").alias("now"), F.array().cast("array<struct<at:bigint,part:double>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["now"] * x["weight"]).alias("now"),
            F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["now"].alias("part")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    composite = steps.where(size > 0).select("host", F.explode(passed).alias("x")).groupBy("host", F.col("x.at").alias("path")).agg(F.sum("x.part").alias("composite"))
    nodes = cut(nodes.join(composite, ["host", "path"]).select("host", "path", "pages", "composite", "content", "chain"), "composites")
    best = F.greatest("composite", F.coalesce("content", F.lit(0.0)))
    branch = nodes.select("host", best.alias("best"), F.explode("chain").alias("path")).groupBy("host", "path").agg(F.max("best").alias("importance"))
    nodes = cut(nodes.join(branch, ["host", "path"]).select("host", "path", "pages", "composite", "content", "importance"), "tree")
    often = counts.where(block).select("host", "path", F.col("value").alias("feature"), "k").join(nodes.select("host", "path", "pages"), ["host", "path"])
    often = often.where((m > 1) & (kc >= m * REPEATED)).select("host", "path", "feature", _known(1 - F.log("k") / F.log("pages"), m).alias("importance"))
    return nodes, often


def extract(pages: DataFrame, *, markup: bool = True) -> DataFrame:
    """pages with `text`, the main text, and `n_chars`, its code points; columns of these names are replaced.

    Needs url and html. Null and empty html has the empty text; broken markup is read as browsers read it, roughly;
    null urls are one host; repeated rows are read alike; a host of one page has markup's priors alone. The pages are
    read twice, once for the hosts' style trees and once for the texts, and are not shuffled unless the trees have over
    BROADCAST_ROWS branches and blocks of little importance; then each page is joined with those that it has.
    Without `markup` the trees alone decide.
    """
    nodes, often = style_tree(pages)
    # of what is over this, markup alone says whether it stays
    low = nodes.where(F.col("importance") < KEEP).select("host", "path", F.lit(-1).cast("long").alias("feature"), "importance")
    tree = low.unionByName(often.where(F.col("importance") < KEEP))
    few = tree.limit(BROADCAST_ROWS + 1).collect()  # bounded
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    shared, source = None, pages.select(*names)
    if len(few) <= BROADCAST_ROWS:
        known: dict[str, tuple[dict, dict]] = {}
        for r in few:
            out, repeated = known.setdefault(r.host, ({}, {}))
            if r.feature < 0:
                out[r.path] = r.importance
            else:
                repeated[r.path, r.feature] = r.importance
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:
        source = _with_tree(source, tree)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        trees = None if shared else batch.column("_tree").to_pylist()
        for k, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if shared:
                out, repeated = shared.value.get(host(url), ({}, {}))
            else:
                out = {x["path"]: x["importance"] for x in trees[k] or () if x["feature"] < 0}
                repeated = {(x["path"], x["feature"]): x["importance"] for x in trees[k] or () if x["feature"] >= 0}
            texts.append(main_text(parse(page), out, repeated, markup))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
        )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema)
    return map_chunks(source, run, f"{kinds}, text string, n_chars long")


def _with_tree(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """pages with _tree: the branches and blocks in tree that the page itself has."""
    rows = cut(pages.withColumn("_row", F.monotonically_increasing_id()), "pages")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for row, url, source in zip(*[batch.column(c).to_pylist() for c in ("_row", "url", "html")], strict=True):
            own, page = host(url), parse(source)
            has = {(path, -1) for path in page.chains} | {(path, _feature(text)) for text, path, _, _ in page.blocks}
            out += [(row, own, path, feature) for path, feature in has]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["_row", "host", "path", "feature"])

    has = map_chunks(rows.select("_row", "url", "html"), run, "_row long, host string, path long, feature long")
    own = has.join(tree, ["host", "path", "feature"]).groupBy("_row").agg(F.collect_list(F.struct("path", "feature", "importance")).alias("_tree"))
    return rows.join(own, "_row", "left").drop("_row")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
