"""Main text of web pages by wrapper induction.

Each page is parsed once, into a tree of block elements (siblings that repeat a label are folded into
one node) and the texts of its blocks.  Pages of a host that share their outer containers form a
layout; its reference is its most frequent tree.  Every page of the layout is aligned with the
reference by simple tree matching (the largest set of matched nodes that keeps labels, ancestors and
sibling order).  A text that stays the same at a matched node over the layout's pages is template;
what varies fills slots.  Content is the slots of the article region; a page that marks no such region
gives the container whose slots hold most text.  Elements that state a role (menus, footers, forms,
adverts, reader comments ...) are never content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import sliced, staged, table

#: A text at a matched node is template if this share of the layout's distinct pages, and MIN_PAGES of them, have it there.
CONSTANT, MIN_PAGES = 0.6, 3
#: Levels of containers, from the document down, that tell layouts apart.
OUTER = 3

_set = lambda s: frozenset(s.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title noscript template iframe noframes xmp")
INLINE = _set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp rb s samp small span strike strong sub sup time tt u var wbr img nobr")
DROPPED = _set("script style noscript template iframe noframes title head nav header footer aside form button select option textarea input svg canvas object embed audio video dialog menu map math xmp")
#: Words of class, id and role attributes that name a part of a page other than the article.
ROLES = _set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary contentinfo widget widgets "
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search form comment comments commentlist reply replies disqus respond social share sharing sharebar "
    "related recommended recommendations pagination pager toolbar skip hidden"
)
ARTICLE = _set("article main")
#: A list of results is content, though its name has the word search.
SEARCH, RESULTS, NONE = _set("search"), _set("result results"), frozenset()
FORM, BY_FORM = _set("form"), 2
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
PROSE = _set("p h1 h2 h3 h4 h5 h6 li ul ol dl blockquote pre td th tr tbody table dt dd figure figcaption hr")
#: Start tags that end an open paragraph.
ENDS_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul")
ENDS = {"li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"), "option": _set("option"), "thead": _set("tr td th"), "tbody": _set("thead tr td th tbody"), "tfoot": _set("tbody tr td th")}
SCOPE = _set("ul ol dl table html body article section div main td th")
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "label", "children", "dropped", "region", "parent", "depth")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool, region: bool):
        self.tag, self.label, self.parent, self.dropped, self.region = tag, label, parent, dropped, region
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []  # nodes and texts


def parse(html: str) -> Node:
    """A tree of nodes and texts; end tags that are missing are supplied, stray ones ignored."""
    root = at = Node("", "", None, False, False)
    pos, n = 0, len(html)
    lower = None
    while pos < n:
        m = TAG.search(html, pos)
        if not m:
            at.children.append(html[pos:])
            break
        if m.start() > pos:
            at.children.append(html[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node.parent and node.tag != tag and not (node.tag in SCOPE and tag in INLINE):
                node = node.parent
            if node.tag == tag and node.parent:
                at = node.parent
            continue
        if tag in ENDS_P:
            node = at
            while node.parent and node.tag != "p" and (node.tag in INLINE):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in ENDS:
            node = at
            while node.parent and node.tag not in ENDS[tag] and node.tag not in SCOPE | ENDS_P - {"p"}:
                node = node.parent
            while node.parent and node.tag in ENDS[tag]:
                at = node = node.parent
        words, names, drop, region = "", (), False, tag in ARTICLE
        if m[3] and len(m[3]) > 3:
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(m[3])}
            if found:
                words = found.get("class", "") + " " + found.get("id", "") + " " + found.get("role", "")
                names = frozenset(re.split(r"[\s_\-]+", words))
                region |= found.get("role") in ARTICLE or found.get("itemprop") == "articlebody"
                drop = "hidden" in found or found.get("aria-hidden") == "true"
        named = bool(names and (names & ROLES) - (SEARCH if names & RESULTS else NONE))
        drop = drop or tag in DROPPED - FORM or (named and tag not in ("html", "body") and not region)
        if region and not drop and at.dropped == BY_FORM:  # the form around a whole page goes, the article in it stays
            node = at
            while node and node.dropped == BY_FORM:
                node.dropped, node = False, node.parent
        kind = at.dropped or (True if drop else BY_FORM if tag in FORM else False)
        node = Node(tag, f"{tag}.{found.get('class', '')}" if words.strip() else tag, at, kind, region)
        at.children.append(node)
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else html
            end = lower.find(f"</{tag}", pos)
            node.children.append(html[pos : end if end >= 0 else n])
            close = html.find(">", end) if end >= 0 else -1
            pos = close + 1 if close >= 0 else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node
    return root


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(node, text) of each block in page order, of nodes that are not dropped: the nearest non-inline element."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    owner: Node | None = None

    def flush() -> None:
        nonlocal owner
        text = SPACE.sub(" ", unescape("".join(held))).strip() if held else ""
        if text:
            out.append((owner, text))
        held.clear()
        owner = None

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag not in INLINE:
            flush()
        done = True
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                if owner is None:
                    owner = node
                held.append(child)
            elif child.dropped:
                if child.tag not in INLINE:
                    flush()
            else:
                stack += [(node, i), (child, 0)]
                done = False
                break
        if done and node.tag not in INLINE:
            flush()
    flush()
    for i, (node, text) in enumerate(out):
        while node.parent and node.tag in INLINE:
            node = node.parent
        out[i] = (node, text)
    return out


# ---------------------------------------------------------------- trees as arrays
@lru_cache(1 << 16)
def _hash(label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass")) - (1 << 63)


def _elements(nodes: list[Node]) -> Iterator[Node]:
    """Block elements below ``nodes`` that are not dropped; inline elements are looked through."""
    stack = [c for node in reversed(nodes) for c in reversed(node.children)]
    while stack:
        c = stack.pop()
        if isinstance(c, str) or c.dropped or c.tag in VOID:
            continue
        if c.tag in INLINE:
            stack += reversed(c.children)
        else:
            yield c


class Page:
    """A parsed page: the folded tree (labels, parents), its layout, and the blocks: node, digest of their element's text, region, text."""

    __slots__ = ("label", "parent", "layout", "at", "digest", "region", "text", "up", "above")

    def __init__(self, html: str):
        root = parse(html)
        found = blocks(root)
        self.label, self.parent, level, of, outer = [_hash("")], [-1], [0], {id(root): 0}, set()
        stack = [(0, [root])]
        while stack:
            f, nodes = stack.pop()
            runs: list[list[Node]] = []
            for c in _elements(nodes):
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            for run in runs:
                k = len(self.label)
                self.label.append(_hash(run[0].label))
                self.parent.append(f)
                level.append(level[f] + 1)
                if level[k] <= OUTER and run[0].tag not in PROSE:
                    outer.add(run[0].label)
                of.update((id(c), k) for c in run)
                stack.append((k, run))
        self.layout = _hash(" ".join(sorted(outer)))
        self.at = [of[id(node)] for node, _ in found]
        self.text = [t for _, t in found]
        whole: dict[int, list[str]] = {}
        for node, t in found:
            whole.setdefault(id(node), []).append(t)
        digest = {k: xxhash.xxh64_intdigest("\n".join(v).encode("utf-8", "surrogatepass")) - (1 << 63) for k, v in whole.items()}
        self.digest = [digest[id(node)] for node, _ in found]
        self.region = [_in_region(node) + HEADING * (node.tag in HEADINGS) for node, _ in found]
        self.up, self.above = [], []
        if not any(r % HEADING for r in self.region):
            number: dict[int, int] = {}
            for node, _ in found:
                up = node.parent if node.tag in PROSE and node.parent else node
                chain = []
                while up and id(up) not in number:
                    chain.append(up)
                    up = up.parent
                for x in reversed(chain):
                    self.above.append(number[id(x.parent)] if x.parent else -1)
                    number[id(x)] = len(self.above) - 1
                self.up.append(number[id(node.parent if node.tag in PROSE and node.parent else node)])


#: Added to the region of a heading.
HEADING = 4


def _in_region(node: Node) -> int:
    """The nearest marked region around a node: 0 none, 1 the main part, 2 an article."""
    while node:
        if node.region:
            return 1 if node.tag == "main" else 2
        node = node.parent
    return 0


# ---------------------------------------------------------------- alignment
class Reference:
    """A folded tree to which others are aligned.

    Equal subtrees share a number, and what two numbers match is worked out once, children row by row,
    so that neither depth nor the number of children is limited.
    """

    def __init__(self, label: list[int], parent: list[int]):
        self.number: dict[tuple, int] = {}
        self.labels: list[int] = []
        self.below: list[tuple] = []
        self.done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.kids, self.shape = self.shapes(label, parent)

    def shapes(self, label: list[int], parent: list[int]) -> tuple[list[list[int]], list[int]]:
        """Children of each node, in order, and the number of its subtree."""
        kids: list[list[int]] = [[] for _ in label]
        for i, p in enumerate(parent):
            if p >= 0:
                kids[p].append(i)
        shape = [0] * len(label)
        for i in range(len(label) - 1, -1, -1):  # parents stand before their children
            key = label[i], tuple([shape[k] for k in kids[i]])
            n = self.number.get(key)
            if n is None:
                n = self.number[key] = len(self.labels)
                self.labels.append(label[i])
                self.below.append(key[1])
            shape[i] = n
        return kids, shape

    def matched(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Size of the largest matching of two subtrees with equal labels, and the children (by place) it pairs."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) not in self.done:
                p, q = self.below[x], self.below[y]
                need = [(i, j) for i in set(p) for j in set(q) if self.labels[i] == self.labels[j] and (i, j) not in self.done]
                if need:
                    stack += need
                    continue
                self.done[x, y] = self._rows(p, q)
            stack.pop()
        return self.done[a, b]

    def _rows(self, p: tuple, q: tuple) -> tuple[int, list[tuple[int, int]]]:
        if not p or not q:
            return 1, []
        kinds, column = np.unique(np.array(q), return_inverse=True)
        weight = {i: np.array([self.done[i, j][0] if self.labels[i] == self.labels[j] else 0 for j in kinds.tolist()], dtype=np.int64) for i in set(p)}
        best, taken, kept = np.zeros(len(q) + 1, dtype=np.int64), [], []
        for i in p:
            w = weight[i][column]
            with_it = best[:-1] + w
            now = np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], np.where(w > 0, with_it, 0)))])
            taken.append(np.packbits((w > 0) & (now[1:] == with_it)))
            kept.append(np.packbits(now[1:] == best[1:]))
            best = now
        bit = lambda row, j: row[j >> 3] >> (7 - (j & 7)) & 1
        pairs, i, j = [], len(p), len(q)
        while i and j:
            if bit(taken[i - 1], j - 1):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif bit(kept[i - 1], j - 1):
                i -= 1
            else:
                j -= 1
        return int(best[-1]) + 1, pairs

    def align(self, label: list[int], parent: list[int]) -> dict[int, int]:
        """Node of the other tree -> the node of this one that it matches."""
        kids, shape = self.shapes(label, parent)
        out: dict[int, int] = {}
        stack = [(0, 0)] if self.labels[self.shape[0]] == self.labels[shape[0]] else []
        while stack:
            i, j = stack.pop()
            out[j] = i
            stack += [(self.kids[i][x], kids[j][y]) for x, y in self.matched(self.shape[i], shape[j])[1]]
        return out


def content(region: list[int], text: list[str], up: list[int], above: list[int], template: set[int]) -> str:
    """The text of the page: article slots, or else the container that holds most of the varying text.

    A heading that is the same on every page is the label of the slot that it stands before, and stays with it; other
    constant text goes.  A marked region without any slot stays as it is: its pages are copies of each other.
    """
    marked = [i for i, r in enumerate(region) if r % HEADING]
    if marked:
        for wanted in (2, 1):
            part = [i for i in marked if region[i] % HEADING >= wanted]
            slots, before = [], False
            for i in reversed(part):
                before = i not in template or before and region[i] >= HEADING
                if before:
                    slots.append(i)
            if slots:
                return "\n".join(text[i] for i in reversed(slots))
            if part:
                return "\n".join(text[i] for i in part)
    rest = [i for i in range(len(text)) if i not in template]
    if not rest:
        return ""
    score: dict[int, float] = {}
    for i in rest:
        at = up[i]
        for share in (1.0, 0.5):
            if at < 0:
                break
            score[at] = score.get(at, 0.0) + share * len(text[i])
            at = above[at]
    depth = [0] * len(above)
    for k, a in enumerate(above):  # ancestors stand before
        depth[k] = depth[a] + 1 if a >= 0 else 0
    top = max(score, key=lambda k: (score[k], depth[k]))
    inside = [False] * len(above)
    for k, a in enumerate(above):
        inside[k] = k == top or a >= 0 and inside[a]
    return "\n".join(text[i] for i in rest if inside[up[i]])


# ---------------------------------------------------------------- Spark
def host_of(url) -> F.Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page once through the parser: its place, its folded tree and its blocks.  ``page`` is a digest of all but the place."""
    kinds = {"label": pa.list_(pa.int64()), "parent": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "digest": pa.list_(pa.int64()), "region": pa.list_(pa.int32()), "text": pa.list_(pa.string()), "up": pa.list_(pa.int32()), "above": pa.list_(pa.int32())}
    names = ["id", "url", "host", "layout", "tree", "page", *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            found = [Page(x or "") for x in batch.column(3).to_pylist()]
            tree = [xxhash.xxh64_intdigest(np.array(p.label + p.parent, dtype=np.int64).tobytes()) - (1 << 63) for p in found]
            page = [xxhash.xxh64_intdigest(np.array([t, *p.at, *p.digest], dtype=np.int64).tobytes()) - (1 << 63) for t, p in zip(tree, found)]
            own = [pa.array([p.layout for p in found], pa.int64()), pa.array(tree, pa.int64()), pa.array(page, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own, *[pa.array([getattr(p, k) for p in found], t) for k, t in kinds.items()]], names)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType())])
    for part in ("host string, layout long, tree long, page long, label array<long>, parent array<int>, at array<int>, digest array<long>", "region array<int>, text array<string>, up array<int>, above array<int>"):
        for field in T.StructType.fromDDL(part):
            schema.add(field)
    return rows.mapInArrow(run, schema)


class _References:
    """References of layouts met lately, each made once from the Arrow row that brings it."""

    def __init__(self):
        self.kept: dict[tuple, tuple[Reference, set]] = {}
        self.nodes = 0

    def get(self, batch: pa.RecordBatch, row: int, key: tuple) -> tuple[Reference, set]:
        known = self.kept.get(key)
        if known is None or len(known[0].number) > 20_000:
            column = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py() or ()
            label = column("ref_label")
            if self.nodes > 200_000:
                self.kept.clear()
                self.nodes = 0
            fixed = set(zip(column("fixed_node"), column("fixed_digest"))) if "fixed_node" in batch.schema.names else set()
            known = self.kept[key] = Reference(label, column("ref_parent")), fixed
            self.nodes += len(label) + len(fixed)
        return known


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, layout, ref_label, ref_parent, fixed_node, fixed_digest) per layout with a template, from ``parsed`` rows.

    Pages that are copies of each other count once.  The reference is the layout's most frequent tree.
    """
    key = ["host", "layout"]
    once = staged(rows.groupBy(*key, "page").agg(*[F.first(c).alias(c) for c in ("tree", "label", "parent", "at", "digest")]), "distinct")
    trees = once.groupBy(*key, "tree").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    most = trees.groupBy(*key).agg(F.sum("n").alias("pages"), F.max(F.struct("n", "tree", "page")).getField("page").alias("page")).where(F.col("pages") >= MIN_PAGES)
    shape = once.select(*key, "page", F.col("label").alias("ref_label"), F.col("parent").alias("ref_parent"))
    refs = staged(most.join(shape, [*key, "page"]).drop("page"), "references")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, seen = _References(), {}

        def out() -> pa.RecordBatch:
            keys = list(seen)
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array(list(seen.values()), pa.int64())], ["host", "layout", "node", "digest", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for row, (host, layout, label, parent, at, digest) in enumerate(zip(*(some.column(k).to_pylist() for k in range(6)))):
                    met = references.get(some, row, (host, layout))[0].align(label, parent)
                    for node, d in {(met[a], d) for a, d in zip(at, digest) if a in met}:
                        seen[host, layout, node, d] = seen.get((host, layout, node, d), 0) + 1
                if len(seen) > 200_000:
                    yield out()
        yield out()

    ready = once.join(refs.select(*key, "ref_label", "ref_parent"), key).select(*key, "label", "parent", "at", "digest", "ref_label", "ref_parent")
    counted = ready.mapInArrow(count, "host string, layout long, node int, digest long, n long").groupBy(*key, "node", "digest").agg(F.sum("n").alias("n"))
    fixed = counted.join(refs.select(*key, "pages"), key).where((F.col("n") >= MIN_PAGES) & (F.col("n") >= CONSTANT * F.col("pages")))
    # each of a layout's pages has at most 1 / CONSTANT times its own blocks' worth of them: bounded by a page
    lists = fixed.groupBy(*key).agg(F.collect_list(F.struct("node", "digest")).alias("fixed"))
    lists = lists.select(*key, F.col("fixed.node").alias("fixed_node"), F.col("fixed.digest").alias("fixed_digest"))
    return refs.join(lists, key).select(*key, "ref_label", "ref_parent", "fixed_node", "fixed_digest")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Null or empty html gives an empty text.  Pages with null urls form a host of their own.  A layout
    with fewer than MIN_PAGES distinct pages has no template; of equally frequent trees the one with
    the largest digest is the reference.  Repeated rows repeat; an empty table gives an empty result;
    extra columns are ignored.
    """
    rows = staged(parsed(pages, id_col, url_col, html_col), "pages", compression="zstd")
    models = staged(wrappers(rows), "wrappers")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References()
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                known = some.column(some.schema.get_field_index("ref_label")).is_valid().to_pylist()
                for row, (host, layout, label, parent, at, digest, region, text, up, above) in enumerate(zip(*(some.column(k).to_pylist() for k in range(2, 12)))):
                    template: set[int] = set()
                    if known[row]:
                        reference, fixed = references.get(some, row, (host, layout))
                        met = reference.align(label, parent)
                        template = {k for k, (a, d) in enumerate(zip(at, digest)) if (met.get(a), d) in fixed}
                    out.append(content(region, text, up, above, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [id_col, url_col, "text"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType())])
    own = ["label", "parent", "at", "digest", "region", "text", "up", "above"]
    ready = rows.join(models, ["host", "layout"], "left").select("id", "url", "host", "layout", *own, "ref_label", "ref_parent", "fixed_node", "fixed_digest")
    return ready.mapInArrow(apply, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op10_html": op10_html}
ORACLE_SQL: dict[str, str] = {}
