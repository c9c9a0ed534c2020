"""Main text of web pages by site style trees.

The pages of a host are merged: for each element path the tree holds how many
pages have the element, in which presentations (sequences of child elements)
and with which contents (text blocks). Presentation importance is the entropy
of the presentations, content importance one minus the mean entropy of the
contents over the pages: what all pages of a host show alike has none. A
branch's composite importance mixes its own presentation with the contents
below it; branches under a bound are removed from each page of the host.

Trees are built as grouped sums, never as one object: pages give (host, path,
kind, hash) rows that are counted, and every entropy follows from sums of
n and n ln n. An element's path has its name and stable classes (those without
digits; ids aren't part of it) and those of the ``LEVELS`` outermost elements
it lies in; what lies deeper is judged with them, and its text is kept or
removed like theirs. A host's importance of a path is shrunk to that of all
hosts by the number of its pages, and that to 1 in the same way, so a host of
one page has the common tree and there is no least number of pages. The names
of elements and classes of menus, adverts and the like remove branches as well,
and a page with a main element gives the text in it.

Null and empty pages have empty text. A null or odd URL belongs to the host
``''``. Copies of a page on a host are one page to its tree: each adds its share
of one. A branch that holds an ``article`` or ``main`` is never removed, branches
inside one are. Broken markup never fails: unclosed elements end with the page,
however deep they are nested. Pages of any length are read whole, in time that
follows their length; a branch whose importance equals the bound stays; repeated
rows give equal texts; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bound and mix of the composite importance; pages that weigh as much as what an importance is shrunk to; levels of a path.
LEAST_IMPORTANCE, OWN_SHARE, SHRINK, LEVELS = 0.35, 0.1, 3.0, 64

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas select textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl td th body html".split())
#: Elements, roles and class words that aren't main text.
DROPPED = frozenset("head nav header footer aside form button dialog menu script style template noscript iframe object svg math canvas select textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of classes and ids that say so wherever they occur, those that say so with none but plain words beside them, and plain words.
STRONG = frozenset("ad ads advert advertisement advertising sponsored cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs sidebar newsletter comment comments disqus masthead pagination pager".split())
WEAK = frozenset("banner sponsor promo promotion menu widget notice notification popup modal subscribe signup social share sharing related recommended replies footer header copyright login toolbar skip".split())
PLAIN = frozenset("site page global box bar area block wrap wrapper container section list item items link links button buttons icon icons top bottom left right inner outer main posts stories articles".split())
MAIN = frozenset("article main".split())
#: Paths that end at one of them, with classes or without.
MAIN_END = r"/(article|main)(\.[^/]*)?$"

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<?[^<]*", re.S)
_attribute = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_word = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
_number = re.compile(r"\d")
_slash = re.compile("/")


class Block:
    __slots__ = ("path", "text", "main", "unwanted")

    def __init__(self, path: str, text: str, main: bool, unwanted: bool):
        self.path, self.text, self.main, self.unwanted = path, text, main, unwanted


class Element:
    """An open element. ``block`` is itself, or of an inline element the block element around it; ``level`` counts from the page."""

    __slots__ = ("tag", "path", "children", "unwanted", "main", "block", "level")

    def __init__(self, tag: str, path: str, unwanted: bool, main: bool, level: int, parent: Element | None):
        self.tag, self.path, self.unwanted, self.main, self.level = tag, path, unwanted, main, level
        self.children: list[str] = []
        self.block = parent.block if parent is not None and tag in INLINE else self


def names_unwanted(value: str) -> bool:
    """Whether a class or id names what isn't main text."""
    for token in value.split():
        found = set(_word.findall(token))
        if not STRONG.isdisjoint(found) or not WEAK.isdisjoint(found) and found <= WEAK | PLAIN:
            return True
    return False


def label(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in a path (with its stable classes), and whether name, role or classes say that it isn't main text."""
    unwanted, stable = tag in DROPPED, set()
    if attributes:
        for name, value in _attribute.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                if name == "class":
                    stable |= {x.replace("/", "_") for x in value.split() if not _number.search(x)}
                if tag not in ("html", "body"):
                    unwanted = unwanted or names_unwanted(value)
            elif name == "role":
                unwanted = unwanted or value in ROLES
            elif name == "hidden" or value == "true":
                unwanted = True
    tag = tag.replace("/", "_")
    if not stable:
        return tag, unwanted
    classes = " ".join(sorted(stable))
    return f"{tag}.{classes if len(classes) <= 40 else xxhash.xxh64_hexdigest(classes.encode('utf-8', 'replace'))}", unwanted


def walk(page: str) -> tuple[list[Block], dict[str, set[str]]]:
    """Text blocks in page order, and the presentations of each element path."""
    blocks: list[Block] = []
    styles: dict[str, set[str]] = {}
    stack = [Element("", "", False, False, 0, None)]
    opened: Counter = Counter()
    held: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = _space.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.path if top.unwanted else top.block.path, text, top.main, top.unwanted))

    def close() -> None:
        e = stack.pop()
        opened[e.tag] -= 1
        if e.tag not in INLINE:
            styles.setdefault(e.path, set()).add(" ".join(e.children))

    while at < n:
        m = _token.match(page, at)
        at = m.end() if m.end() > at else at + 1
        tag = m[2]
        if tag is None:
            s = m[0]
            if not s.startswith(("<!", "<?")):
                held.append(s)
            elif s.startswith("<![CDATA["):
                held.append(entities.escape(s[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:  # end tag
            if opened[tag] > 0:
                if tag not in INLINE:
                    flush()
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
                continue
        else:
            flush()
            # a paragraph ends where a block begins, with the inline elements open in it
            if tag in CLOSES_P and stack[-1].block.tag == "p":
                paragraph = stack[-1].block
                while stack[-1] is not paragraph:
                    close()
                close()
            if tag in ENDS and any(opened[x] > 0 for x in ENDS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        while len(stack) > k:
                            close()
                        break
                    if stack[k].tag in SCOPES:
                        break
        attributes = m[3] or ""
        name, bad = label(tag, attributes)
        parent = stack[-1]
        if tag not in INLINE and (not parent.children or parent.children[-1] != name):
            parent.children.append(name)
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        bad = bad or parent.unwanted
        if attributes.endswith("/") and tag not in CLOSES_P:
            continue
        path = f"{parent.path}/{name}" if parent.level < LEVELS else parent.path
        main = (parent.main or tag in MAIN or "role=\"main\"" in attributes) and not bad
        stack.append(Element(tag, path, bad, main, parent.level + 1, parent))
        opened[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    return blocks, styles


def main_text(page: str | None, low: list[str] | None) -> str:
    """The page's main text, without the branches ``low`` of its host's tree."""
    if not page:
        return ""
    blocks, _ = walk(page)
    removed = frozenset(low) if low is not None and len(low) else frozenset()
    lost: dict[str, bool] = {}

    def in_removed(path: str) -> bool:
        """Whether the path or one above it is removed; each path is looked up once."""
        if path not in lost:
            ends = [m.start() for m in _slash.finditer(path)][1:] + [len(path)]
            lost[path] = any(path[:e] in removed for e in ends)
        return lost[path]

    kept = [b for b in blocks if not b.unwanted and not (removed and in_removed(b.path))]
    if any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    return "\n".join(b.text for b in kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def shares(pages: DataFrame) -> DataFrame:
    """host, html, share of every page: one divided by the number of its copies on the host."""
    rows = pages.select(host(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("page"))
    copied = common.materialise(rows.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    rows = common.join_small(rows, copied, ["host", "page"], "left", copied.count())
    return rows.select("host", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))


def observations(pages: DataFrame) -> DataFrame:
    """host, path, kind (0 presentation, 1 content), hash, share: what each page adds to its host's tree."""
    common.text_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            hosts, paths, kinds, hashes, parts = [], [], [], [], []
            for h, page, share in zip(b["host"], b["html"], b["share"]):
                if not page:
                    continue
                blocks, styles = walk(page)
                seen = {(x.path, 1, x.text) for x in blocks} | {(p, 0, s) for p, x in styles.items() for s in x}
                for path, kind, what in seen:
                    hosts.append(h)
                    paths.append(path)
                    kinds.append(kind)
                    hashes.append(xxhash.xxh64_intdigest(what.encode("utf-8", "replace")) - (1 << 63))
                    parts.append(share)
            yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "path": pd.Series(paths, dtype=object), "kind": np.array(kinds, np.int8), "hash": np.array(hashes, np.int64), "share": np.array(parts, np.float64)})

    return shares(pages).mapInPandas(run, "host string, path string, kind byte, hash long, share double")


def low_branches(pages: DataFrame, least: float = LEAST_IMPORTANCE, own: float = OWN_SHARE, shrink: float = SHRINK) -> DataFrame:
    """host, low array<string>: the highest branches of each host whose composite importance is under ``least``."""
    seen = observations(pages).groupBy("host", "path", "kind", "hash").agg(F.round(F.sum("share")).alias("n"))
    n = F.col("n")
    sums = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias("style"),
        F.sum(F.when(F.col("kind") == 1, n)).alias("contents"),
        F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("content"),
    )
    sums = common.materialise(sums, "styles")
    # each path adds its contents to all branches that hold it
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))
    below = sums.filter("contents > 0").select("host", F.explode(above).alias("path"), "contents", "content")
    below = below.groupBy("host", "path").agg(F.sum("contents").alias("below"), F.sum("content").alias("below_log"))
    tree = sums.select("host", "path", "pages", "style").join(below, ["host", "path"])
    of_page = F.log("pages")
    style = 1 - F.col("style") / (F.col("pages") * of_page)
    content = 1 - F.least(F.lit(1.0), F.col("below_log") / (F.col("below") * of_page))
    # a page alone tells nothing: all but the first count
    tree = tree.select("host", "path", (F.col("pages") - 1).alias("more"), F.when(F.col("pages") > 1, own * style + (1 - own) * content).otherwise(F.lit(1.0)).alias("importance"))
    tree = common.materialise(tree, "trees")
    pooled = tree.groupBy("path").agg(((F.sum(F.col("more") * F.col("importance")) + shrink) / (F.sum("more") + shrink)).alias("pooled"))
    pooled = common.materialise(pooled, "pooled")
    tree = common.join_small(tree, pooled, ["path"], "inner", pooled.count(), 256)
    low = tree.filter((F.col("more") * F.col("importance") + shrink * F.col("pooled")) / (F.col("more") + shrink) < least)
    low = low.filter(~F.col("path").rlike(r"^(/html[^/]*)?(/body[^/]*)?$") & ~F.col("path").rlike(MAIN_END))
    # what holds an article or main stays, whatever its importance
    holders = F.filter(above, lambda p: p.rlike(MAIN_END))
    outer = sums.select("host", F.explode(holders).alias("main")).distinct()
    steps = F.split("main", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))
    outer = outer.select("host", F.explode(above).alias("path")).distinct()
    low = low.join(outer, ["host", "path"], "left_anti")
    return low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = common.materialise(low_branches(pages), "low")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    n, size = trees.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws("/", "low"))), F.lit(0))).first()
    each = size // max(1, n) + 64
    salts = 1 if n <= common.BROADCAST_ROWS and n * each <= common.BROADCAST_BYTES else 64
    # a host of many pages is spread over salts when its tree isn't broadcast
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    trees = trees.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rows = common.join_small(rows, trees, ["host", "salt"], "left", n, each)

    @F.pandas_udf("string")
    def run(page: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, x) for p, x in zip(page, low)], dtype=object)

    rows = rows.select("page_id", "url", run("html", "low").alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark, sf_dir):
    return extract(common.table(spark, sf_dir, "pages"))
