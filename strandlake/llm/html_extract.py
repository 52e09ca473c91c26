"""HTML extraction by wrapper induction.

Pages of one host share a wrapper. Each page's DOM is reduced to a skeleton (runs of like siblings become
one node) and aligned with the skeleton of the host's reference page by simple tree matching. Over all
different pages of a host that tells, for each node of the wrapper, whether its text is the same on nearly
all of them (template) or varies (a slot), and how much text its slots hold. The content root is where that
text is: from the top the wrapper is followed into the container that holds nearly all of it. The main text is
what the slots below the root hold.

Two things can't be seen from what varies and what not, and are read from the markup: elements that never
hold an article's text (menus, forms, scripts, ...; adverts, notices and comments by their names), and an
element that says it is the article, whose text counts many times when the root is chosen.

A host with fewer than MIN_PAGES different pages has no template; each of its pages is its own wrapper.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .url_rules import host_of

MIN_PAGES = 4  # aligned different pages of a host before its template counts
CONSTANT = 0.9  # share of them on which a template node has the same text
COMMON = 0.5  # share of all different pages of the host on which it has that text
HOLDS = 0.8  # share of a node's text that a container below must hold to be followed
NARROW = 4096  # cells of a table of siblings that are kept as they are
NAMED = {"article": 20, "main": 10}  # how many times the text of an element counts that says it is the article

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("#root html body article main section div center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("title script style noscript template head nav footer aside form button select textarea option iframe object svg canvas audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: A container counts as one of these if one of its names is made of these words alone: "ad", "cookie-notice".
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist respond reply replies discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager copyright legal "
    "box bar block area section list form links link site page the top bottom left right".split()
)
#: Words of MARKS that say nothing alone.
WEAK = frozenset("box bar block area section list form links link site page the top bottom left right".split())
MARKED = frozenset("div section ul ol dl table span center figure header details".split())
PAGE_HEADER = frozenset("header masthead topbar".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl body article section div main".split())


def _marked(names: list[str]) -> bool:
    for name in names:
        words = {w for w in re.split(r"[_\-]+", name) if w}
        if words and words <= MARKS and not words <= WEAK:
            return True
    return False


class Node:
    __slots__ = ("tag", "label", "skip", "items", "inside", "link")

    def __init__(self, tag: str, attrs: list, parent: Node | None) -> None:
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        self.tag, self.items = tag, []
        self.label = f"{tag}.{a.get('class', '')}"
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.link = tag == "a" or bool(parent and parent.link)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        self.skip = bool(parent and parent.skip) or hidden or tag in NEVER or tag not in ("body", "html", "main", "article") and a.get("role", "").lower() in ROLES or tag in MARKED and _marked(names)
        if not self.inside and (tag == "header" or tag in MARKED and PAGE_HEADER & set(names)):
            self.skip = True


class Tree(HTMLParser):
    """A DOM that forgives: paragraphs end where a block begins, unmatched ends are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", [], None)
        self.stack = [self.root]

    @classmethod
    def of(cls, html: str) -> Node:
        t = cls()
        t.feed(html)
        t.close()
        return t.root

    def _end(self, tags: tuple, scope: frozenset) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end(("p",), SCOPE)
        if tag in CLOSES:
            self._end(CLOSES[tag], frozenset(("table", "ul", "ol", "dl")))
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].items.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        self._end((tag,), frozenset())

    def handle_data(self, data: str) -> None:
        self.stack[-1].items.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """<![...]> is a comment of no meaning here, whatever it holds."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


# --- skeletons and their alignment ---------------------------------------------------------------


class Skeleton:
    """Nodes in preorder: label, hash of the own text (0 without), its length where it may be content, children."""

    def __init__(self, labels: list[str], hashes: list[int], sizes: list[int], kids: list[list[int]]) -> None:
        self.labels, self.hashes, self.sizes, self.kids = labels, hashes, sizes, kids

    @classmethod
    def of(cls, root: Node) -> tuple[Skeleton, list[list[Node]]]:
        """The skeleton of a DOM, and the DOM nodes of each of its nodes. Like siblings in a row are one node."""
        out, groups = cls([], [], [], []), []
        todo: list[tuple[list[Node], int]] = [([root], -1)]
        while todo:
            group, parent = todo.pop()
            number = len(groups)
            if parent >= 0:
                out.kids[parent].append(number)
            groups.append(group)
            text = " ".join(" ".join([x for n in group for x in n.items if isinstance(x, str)]).split())
            out.labels.append(group[0].label)
            out.hashes.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0)
            out.sizes.append(0 if group[0].skip or group[0].link else len(text))
            out.kids.append([])
            runs: list[list[Node]] = []
            for n in group:
                for child in n.items:
                    if not isinstance(child, str):
                        if runs and runs[-1][0].label == child.label:
                            runs[-1].append(child)
                        else:
                            runs.append([child])
            if len(group) > 1:  # of a repeated node the children of one label are one node
                by: dict[str, list[Node]] = {}
                for r in runs:
                    by.setdefault(r[0].label, []).extend(r)
                runs = list(by.values())
            todo += [(r, number) for r in reversed(runs)]
        return out, groups

    def to_json(self) -> str:
        return json.dumps([self.labels, self.hashes, self.sizes, self.kids])

    @classmethod
    def from_json(cls, text: str) -> Skeleton:
        return cls(*json.loads(text))


def shapes(tree: Skeleton, known: dict) -> list[int]:
    """Of each node a number that equal subtrees (of labels, in order) share; `known` keeps them for further trees."""
    out = [0] * len(tree.labels)
    for x in range(len(out) - 1, -1, -1):
        out[x] = known.setdefault((tree.labels[x], *[out[k] for k in tree.kids[x]]), len(known))
    return out


def aligned(weight: dict, rows: list[int], columns: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """(weight, pairs of places from the last to the first) of the heaviest alignment of rows to columns in order.

    weight: of the pairs of kinds (row, column) that may meet. Of wide tables every `step`-th line is kept and
    those between are made again on the way back, so n siblings take n ** 1.5 numbers.
    """
    if len(rows) * len(columns) <= NARROW:
        table, step = [[0] * (len(columns) + 1)], len(rows) or 1
        for r in rows:
            above, line = table[-1], [0]
            for k, c in enumerate(columns):
                w = weight.get((r, c))
                line.append(max(above[k + 1], line[k], above[k] + w if w else 0))
            table.append(line)
        kept, top = [table[0]], table[-1][-1]
    else:
        kinds, which = np.unique(columns, return_inverse=True)
        by_row = {r: np.array([weight.get((r, c), -1) for c in kinds.tolist()], np.int64) for r in set(rows)}
        step = math.isqrt(len(rows)) + 1

        def lines(line: np.ndarray, part: list[int]):
            for r in part:
                w, above = by_row[r][which], line
                line = np.zeros_like(above)
                np.maximum.accumulate(np.maximum(above[1:], np.where(w > 0, above[:-1] + w, 0)), out=line[1:])
                yield line

        kept = [np.zeros(len(columns) + 1, np.int64)]
        for at in range(0, len(rows), step):
            for line in lines(kept[-1], rows[at : at + step]):
                pass
            kept.append(line)
        top, table = int(kept.pop()[-1]), None
    pairs, j = [], len(columns)
    for block in range(len(kept) - 1, -1, -1):
        if len(kept) > 1 or table is None:
            table = [kept[block], *lines(kept[block], rows[block * step : (block + 1) * step])]
        i = len(table) - 1
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((block * step + i, j))
    return top, pairs


def match(a: Skeleton, b: Skeleton) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of the largest top-down alignment that keeps order and labels.

    Subtrees of equal shapes are aligned once, however often they occur.
    """
    if a.labels[0] != b.labels[0]:
        return []
    known: dict = {}
    shape_a, shape_b = shapes(a, known), shapes(b, known)
    kids = {s: key for key, s in known.items()}  # (label, shapes of the children)
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(shape_a[0], shape_b[0])]
    while todo:
        x, y = todo[-1]
        if (x, y) in best:
            todo.pop()
            continue
        by: dict[str, set[int]] = {}
        for c in kids[y][1:]:
            by.setdefault(kids[c][0], set()).add(c)
        weight, open_ = {}, []
        for r in set(kids[x][1:]):
            for c in by.get(kids[r][0], ()):
                if len(kids[r]) == 1 or len(kids[c]) == 1:
                    weight[r, c] = 1
                elif (r, c) in best:
                    weight[r, c] = best[r, c][0]
                else:
                    open_.append((r, c))
        if open_:
            todo += open_
            continue
        todo.pop()
        n, pairs = aligned(weight, list(kids[x][1:]), list(kids[y][1:])) if weight else (0, [])
        best[x, y] = (n + 1, pairs)
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if a.kids[x] and b.kids[y]:
            todo += [(a.kids[x][i], b.kids[y][j]) for i, j in best[shape_a[x], shape_b[y]][1]]
    return out


def content_root(tree: Skeleton, mass: list[int]) -> int:
    """The node that the varying text lies under; mass: of each node's own text, how much varies."""
    tags = [x.split(".")[0] for x in tree.labels]
    total, whole = [0] * len(mass), [0] * len(mass)
    for x in range(len(mass) - 1, -1, -1):
        whole[x] = mass[x] + sum(total[k] for k in tree.kids[x])
        total[x] = whole[x] * NAMED.get(tags[x], 1)
    at = 0
    while tags[at] != "article":
        below = [k for k in tree.kids[at] if tags[k] in CONTAINERS and total[k] >= HOLDS * whole[at] > 0]
        named = [k for k in below if tags[k] in NAMED]
        if not below or not named and any(tags[k] in HEADINGS and total[k] for k in tree.kids[at]):
            break  # text of its own, or a heading beside it, would be left behind
        at = (named or below)[0]
    return at


# --- text ----------------------------------------------------------------------------------------


def main_text(roots: list[Node], template: set[int]) -> str:
    """Blocks below the roots, without template nodes' own text (by id()) and what never counts."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    tops = {id(r) for r in roots}
    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.skip:
            block = x.tag in BLOCKS or id(x) in tops
            if block:
                flush()
                todo.append(None)
            own = id(x) not in template
            todo += [k for k in reversed(x.items) if own or not isinstance(k, str)]
    flush()
    return "\n\n".join(blocks)


def _skeletons(batches):
    for batch in batches:
        made = [Skeleton.of(Tree.of(h))[0].to_json() for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("host"), pa.array(made, pa.string())], names=["host", "reference"])


def _votes(batches):
    """For each host and node of its reference: skeletons that have the node, those with the same text, their text's length."""
    for batch in batches:
        seen: dict[tuple[str, int], list[int]] = {}
        last = ref = None
        for host, text, page in zip(*(batch.column(c).to_pylist() for c in ("host", "reference", "page")), strict=True):
            if text != last:
                last, ref = text, Skeleton.from_json(text)
            own = Skeleton.from_json(page)
            for a, b in match(ref, own):
                if ref.hashes[a] or own.hashes[b]:
                    v = seen.setdefault((host, a), [0, 0, 0])
                    v[0] += 1
                    v[1] += ref.hashes[a] == own.hashes[b]
                    v[2] += own.sizes[b]
        keys = list(seen)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3)]]
        yield pa.record_batch(columns, names=["host", "node", "pages", "same", "mass"])


def _extract(batches):
    last = ref = start = None
    for batch in batches:
        texts = []
        for reference, nodes, html in zip(*(batch.column(c).to_pylist() for c in ("reference", "nodes", "html")), strict=True):
            root, template = Tree.of(html), set()
            own, groups = Skeleton.of(root)
            roots = None
            if reference is not None:
                constant = {n["node"] for n in nodes if n["constant"]}
                if reference != last:
                    last, ref = reference, Skeleton.from_json(reference)
                    mass = [0] * len(ref.labels)
                    for n in nodes:
                        mass[n["node"]] = 0 if n["constant"] else n["mass"]
                    start = content_root(ref, mass)
                for a, b in match(ref, own):
                    if a == start:
                        roots = groups[b]
                    if a in constant and own.hashes[b] == ref.hashes[a]:
                        template |= {id(n) for n in groups[b]}
            if roots is None:  # without a wrapper, or a page that hasn't its root
                mass = [0 if id(g[0]) in template else n for g, n in zip(groups, own.sizes, strict=True)]
                roots = groups[content_root(own, mass)]
            texts.append(main_text(roots, template))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html).

    Blocks in page order, joined by two line feeds; white space inside a block becomes one space; character
    references are decoded. Null or empty html gives an empty text, also where ids are null or repeat; other
    columns are ignored. Pages without a host are one host of their own. A repeated row is judged once more.
    Pages whose skeletons and texts are equal have one vote on their host's wrapper; blank pages have none.
    The reference page of a host is the one of the smallest page_id, then html, that isn't blank. Markup may
    nest as deep as it likes and be as broken as it likes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    full = rows.where("trim(html) <> ''").select("host", "page_id", "html")
    # pre-aggregated where the pages are: a host that has a third of them sends one page a task
    firsts = full.groupBy("host").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "html")).alias("first")).where(f"n >= {MIN_PAGES}")
    references = written(firsts.select("host", F.col("first.html").alias("html")).mapInArrow(_skeletons, "host string, reference string"))
    pages_of = full.join(references.select("host"), "host", "left_semi").select("host", "html")
    different = written(pages_of.mapInArrow(_skeletons, "host string, reference string").withColumnRenamed("reference", "page").distinct())
    total = different.groupBy("host").agg(F.count("*").alias("total")).where(f"total >= {MIN_PAGES}")
    votes = different.join(references, "host").mapInArrow(_votes, "host string, node int, pages long, same long, mass long").groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "mass")])
    constant = F.expr(f"pages >= {MIN_PAGES} and same >= {CONSTANT} * pages and same >= {COMMON} * total")
    # at most as many entries as a skeleton has nodes
    nodes = votes.join(total, "host").groupBy("host").agg(F.collect_list(F.struct("node", constant.alias("constant"), "mass")).alias("nodes"))
    wrappers = written(references.join(nodes, "host"))
    return rows.join(wrappers, "host", "left").mapInArrow(_extract, "page_id long, url string, text string")


def op7(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
