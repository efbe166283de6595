"""Main text of pages by wrapper induction over the pages of a host.

The pages of a host with the same structural elements, classes and ids are a
layout, and its page of middling length is their pattern (small layouts share the
largest one's).  Every page's DOM tree is aligned with its pattern by simple tree
matching; a pattern text whose block says the same in almost all differing pages
that it stands for is template, the rest are slots.  A page's text is then what
is not template, without elements whose role (by tag, class or id) is not the
article's; where ``article`` or ``main`` elements hold half of what is left or
more, only what lies in them.

Defined results: a null html is an empty page and has no text; pages without a
host share one; a host or layout with fewer than ``least_pages`` differing pages has no
template of its own; equal pages count once for the template; ``br`` is white space;
headings in the article belong to it; repeated rows are returned once each;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
                   # a value in quotes follows a "="; any other quote is a character like others, and nothing is tried twice
                   r"|<([a-zA-Z][^\s/>]*)((?>[^<>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>?", re.DOTALL)
MARK = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul center".split())
CLOSES = {  # an opening tag ends these open elements
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table html body article section div main aside nav td th".split())
DROPPED = frozenset("head script style noscript template nav footer aside form iframe svg canvas object button select textarea "
                    "input dialog menu audio video map math".split())
# Words that name a role when they are a whole class, id or role.
ROLES = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|masthead|footer|"
    r"comments?|reply|replies|disqus|notice|alert|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|copyright|"
    r"complementary|contentinfo|navigation|skip)", re.IGNORECASE)
# Of these, the ones that name it also as a part of a longer name; the others do
# (side-by-side, social-history, related-work) only where the element holds no prose.
CLEAR = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|nav\w*|breadcrumbs?|masthead|footer|comments?|disqus|cookies?|"
                   r"consent|gdpr|popup|newsletter|signup|pagination|pager|copyright)", re.IGNORECASE)
PARTS = re.compile(r"[_-]+")
READERS = re.compile(r"(?:^|[\s_=-])(?:comments?|reply|replies)(?:$|[\s_-])", re.IGNORECASE)
HEADER = re.compile(r"(?:^| )(?:class|id)=(?:[^=]*[\s_-])?header(?:$|[\s_-])", re.IGNORECASE)
SKELETON = r"""<(?:header|footer|nav|aside|main|article|section|form)\b|\s(?:class|id)=["']?[A-Za-z_ -]+"""  # for Spark's matcher


class Node:
    """An element (``tag``) or a piece of text (``tag`` None)."""
    __slots__ = ("tag", "mark", "text", "below", "print", "shape", "count", "number", "home", "said")

    def __init__(self, tag, mark="", text=""):
        self.tag, self.mark, self.text, self.below = tag, mark, text, []


def parse(html: str) -> Node:
    """The DOM tree, with HTML's rules for unclosed elements as far as they
    change what text stands where."""
    root = Node("#root")
    stack, at = [root], 0

    def put(text):
        if text and not text.isspace():
            stack[-1].below.append(Node(None, text=text))
        elif text:
            stack[-1].below.append(Node(None, text=" "))

    def close(tags, until):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        text = html[at:m.start() if m else size]
        put(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                put(" ")
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].below.append(Node("p"))
            else:
                close((tag,), ("article", "main", "body") if tag not in ("article", "main", "body", "html") else ())
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCK:
                close(("p",), ("td", "th", "li", "blockquote", "div", "article", "section", "main", "body"))
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE - set(CLOSES[tag]) - {"td", "th"} if tag in ("tr", "tbody", "tfoot") else SCOPE - set(CLOSES[tag]))
            node = Node(tag, " ".join(f"{a.lower()}={b or c or d}" for a, b, c, d in MARK.findall(m[3])) if m[3] else "")
            stack[-1].below.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else size
            elif tag not in VOID and not m[3].rstrip().endswith("/"):
                stack.append(node)
            elif tag in VOID or m[3].rstrip().endswith("/"):
                if tag not in VOID:
                    stack.append(node)  # a slash does not close an ordinary element
    return root


def number(root: Node) -> Node:
    """Number the nodes in order; give each a fingerprint of what it holds, one
    of its elements alone, and its count of nodes; give each text the block
    whose line it belongs to, and each block what its line says.  Fingerprints
    are compared within one process only."""
    order, stack = [], [(root, root)]
    while stack:
        node, home = stack.pop()
        node.number = len(order)
        order.append(node)
        if node.tag is None:
            words = node.text.split()
            node.home, node.print = home, hash(tuple(words))
            home.said += words
        else:
            if node is root or node.tag in BLOCK:
                home, node.said = node, []
            stack.extend([(c, home) for c in reversed(node.below)])
    for node in reversed(order):
        if node.tag is None:
            node.shape = node.count = 1
        else:
            own = (node.tag, node.mark)
            node.print = hash((own, *[c.print for c in node.below]))
            node.shape = hash((own, *[c.shape for c in node.below]))
            node.count = 1 + sum([c.count for c in node.below])
    return root


def same_line(a: Node, b: Node) -> bool:
    """Whether two texts stand in blocks that say the same."""
    return a.home.said == b.home.said


def alike(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.mark == b.mark


def long_match(x: list[Node], y: list[Node], size) -> tuple[float, list[tuple[Node, Node]]]:
    """What the table of ``match`` gives for two child lists, with some of its
    rows held: the others are computed again on the way back."""
    kinds: dict = {}
    code = lambda c: kinds.setdefault((c.tag, c.mark), len(kinds))
    kind, shape, said = (np.array([f(c) for c in y], np.int64) for f in (code, lambda c: c.shape, lambda c: c.print))

    def after(above, c):
        weight = np.where(shape == c.shape, float(c.count), -np.inf)
        for j in np.flatnonzero((kind == code(c)) & (shape != c.shape)).tolist():
            weight[j] = size(c, y[j])
        weight += 0.5 * (said == c.print)
        return np.append(0.0, np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weight)))

    step = max(1, int(len(x) ** 0.5))
    row, held = np.zeros(len(y) + 1), []
    for i, c in enumerate(x):
        if i % step == 0:
            held.append(row)
        row = after(row, c)
    total, picked, j = float(row[-1]), [], len(y)
    for block in range(len(held) - 1, -1, -1):
        rows = [held[block]]
        for c in x[block * step:(block + 1) * step]:
            rows.append(after(rows[-1], c))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                picked.append((x[block * step + i - 1], y[j - 1]))
                i, j = i - 1, j - 1
    return total, picked[::-1]


def match(a: Node, b: Node, cells: int = 40_000, remember: int = 500_000) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of a largest order-keeping match of two trees
    whose roots are alike.  Children are matched by dynamic programming over the
    sizes of their own matches; where the table would pass ``cells`` by rows of
    numbers, with the same result.  At most about ``remember`` matches are kept,
    those that are asked for again are found again."""
    memo: dict[tuple[int, int], float] = {}
    choice: dict[tuple[int, int], list[tuple[Node, Node]]] = {}

    def size(a, b):
        if a.shape == b.shape:  # the whole of both, place by place, is a largest match
            return a.count
        if not a.below or not b.below:
            return 1
        key = (a.number, b.number)
        if key in memo:
            return memo[key]
        if len(memo) > remember:
            memo.clear()
            choice.clear()
        x, y = a.below, b.below
        if len(x) * len(y) > cells:
            total, picked = long_match(x, y, size)
            memo[key], choice[key] = 1 + total, picked
            return memo[key]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            row, above, c = best[i], best[i - 1], x[i - 1]
            for j in range(1, len(y) + 1):
                w = max(row[j - 1], above[j])
                d = y[j - 1]
                if alike(c, d):
                    # equal content weighs a little more than a bare likeness
                    w = max(w, above[j - 1] + size(c, d) + (0.5 if c.print == d.print else 0))
                row[j] = w
        picked, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                picked.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
        memo[key], choice[key] = 1 + best[-1][-1], picked[::-1]
        return memo[key]

    if not alike(a, b):
        return []
    size(a, b)
    out, stack = [], [(a, b)]
    while stack:
        a, b = pair = stack.pop()
        out.append(pair)
        if a.shape == b.shape:
            stack.extend(zip(a.below, b.below, strict=True))
        elif a.below and b.below:
            if (a.number, b.number) not in choice:
                size(a, b)
            stack.extend(choice[a.number, b.number])
    return out


def shallow(node: Node, depth: int = 200) -> Node:
    """Fold what lies deeper than ``depth`` into the node there, so that the
    recursion of the match is bounded; the texts keep their order."""
    stack = [(node, 0)]
    while stack:
        n, d = stack.pop()
        if d >= depth and n.below:
            flat, inner = [], list(reversed(n.below))
            while inner:
                c = inner.pop()
                if c.tag is None:
                    flat.append(c)
                elif not dropped(c):
                    inner.extend(reversed(c.below))
            n.below = flat
        stack.extend((c, d + 1) for c in n.below)
    return node


def tree(html: str) -> Node:
    return number(shallow(parse(html)))


@lru_cache(maxsize=64)
def pattern_tree(html: str) -> Node:
    return tree(html)


@lru_cache(maxsize=64)
def pattern_texts(html: str) -> set[int]:
    return open_texts(pattern_tree(html))


def dropped(node: Node) -> bool:
    """Whether an element's role is not the article's."""
    if node.tag in DROPPED:
        return True
    if not node.mark:
        return False
    if re.search(r"(?:^| )(?:hidden=|aria-hidden=true|style=[^=]*display:\s*none)", node.mark):
        return True
    if node.tag == "article":
        return bool(READERS.search(node.mark))
    if node.tag in ("html", "body", "main"):
        return False
    names = [w for m in re.split(r" (?=(?:class|id|role)=)", node.mark) if m.startswith(("class=", "id=", "role="))
             for w in m.split("=", 1)[1].split()]
    if any(ROLES.fullmatch(w) for w in names):
        return True
    parts = {p for w in names for p in PARTS.split(w)}
    if any(CLEAR.fullmatch(p) for p in parts):
        return True
    return any(ROLES.fullmatch(p) for p in parts) and not prose(node)


def prose(node: Node) -> bool:
    """Whether a heading or a paragraph below holds words outside links."""
    stack = [(node, False)]
    while stack:
        n, held = stack.pop()
        if n.tag is None:
            if held and not n.text.isspace():
                return True
        elif n.tag != "a":
            held = held or n.tag in ("p", "h1", "h2", "h3")
            stack.extend((c, held) for c in n.below)
    return False


def titled(node: Node) -> bool:
    """Whether a header holds a heading, and so may be the article's own."""
    return any(c.tag in ("h1", "h2", "h3") or any(g.tag in ("h1", "h2", "h3") for g in c.below) for c in node.below)


def mains(root: Node) -> list[Node]:
    """The outermost article or main elements outside dropped ones; the root
    without any, or if more than half of the text lies outside them."""
    found, inside, outside, stack = [], 0, 0, [(root, False)]
    while stack:
        n, held = stack.pop()
        if n.tag is None:
            size = 0 if n.text.isspace() else len(n.text)
            inside, outside = inside + size * held, outside + size * (not held)
            continue
        if n is not root and dropped(n):
            continue
        if not held and (n.tag in ("article", "main") or n.mark and re.search(r"(?:^| )role=(?:main|article)(?: |$)", n.mark)):
            found.append(n)
            held = True
        stack.extend((c, held) for c in reversed(n.below))
    return found if found and inside >= outside else [root]


def text_of(root: Node, template: set[int]) -> str:
    """Blocks of text outside dropped elements and template nodes (by number)."""
    blocks, line = [], []

    def end():
        said = " ".join("".join(line).split())
        line.clear()
        if said:
            blocks.append(said)

    stack = [(n, False) for n in reversed(mains(root))]
    while stack:
        n, over = stack.pop()
        if over:
            end()
            continue
        if n.number in template:
            continue
        if n.tag is None:
            line.append(n.text)
            continue
        if dropped(n):
            continue
        if (n.tag == "header" or n.mark and HEADER.search(n.mark)) and not titled(n):
            continue
        if n.tag == "br":
            line.append(" ")
        if n.tag in BLOCK:
            end()
            stack.append((n, True))
        stack.extend((c, False) for c in reversed(n.below))
    end()
    return "\n".join(blocks)


def template_of(root: Node, pattern: str | None, constant: list[int] | None) -> set[int]:
    """Texts of a page that are a constant text of the pattern, in its place."""
    if not pattern or not constant:
        return set()
    fixed = set(constant)
    return {b.number for a, b in match(pattern_tree(pattern), root) if a.number in fixed and same_line(a, b)}


def open_texts(root: Node) -> set[int]:
    """Numbers of the texts that no element's role drops."""
    out, stack = set(), [root]
    while stack:
        n = stack.pop()
        if n.tag is None:
            if not n.text.isspace():
                out.add(n.number)
        elif not dropped(n):
            stack.extend(n.below)
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def layout_of(html: Column) -> Column:
    """Names the structural elements, classes and ids (up to a digit) of a page."""
    found = F.regexp_extract_all(html, F.lit(SKELETON), F.lit(0))
    return F.xxhash64(F.array_sort(F.array_distinct(found)))


def induce(pages: DataFrame, least_pages: int = 5, share: float = 0.9) -> DataFrame:
    """``host, layout, pattern, constant``: the pattern page of every layout of
    a host, and the numbers of its template texts, where it has any.

    A layout of ``least_pages`` pages has its own page of middling length as
    pattern; a smaller one uses that of the host's largest layout, and where no
    layout is large enough, the host's page of middling length."""
    sized = common.staged(pages.select("host", "layout", F.length("html").alias("n"), F.xxhash64("html").alias("k")).where("n > 0").distinct(), "sizes")

    def chosen(*by):
        # a table, so that the join is free to split a large host
        middle = common.staged(sized.groupBy(*by).agg(F.percentile_approx("n", 0.5).alias("m"), F.count("*").alias("pages")).where(
            F.col("pages") >= least_pages), "middles")
        return common.staged(sized.join(middle, list(by)).groupBy(*by, "pages").agg(
            F.min(F.struct(F.abs(F.col("n") - F.col("m")), "k"))["k"].alias("k")), "chosen")

    own = chosen("host", "layout")
    largest = own.groupBy("host").agg(F.max(F.struct("pages", "k"))["k"].alias("large"))
    whole = chosen("host").select("host", F.col("k").alias("whole"))
    every = sized.groupBy("host", "layout").agg(F.count("*").alias("n"))
    names = common.staged(
        every.join(own.select("host", "layout", "k"), ["host", "layout"], "left").join(largest, "host", "left").join(whole, "host", "left")
        .select("host", "layout", F.coalesce("k", "large", "whole").alias("k")).where("k IS NOT NULL"), "names")
    page = common.staged(pages.select("host", F.xxhash64("html").alias("k"), "html").join(names.select("host", "k").distinct(), ["host", "k"])
                         .groupBy("host", "k").agg(F.min("html").alias("pattern")), "patterns")
    pattern = common.staged(names.join(page, ["host", "k"]), "layouts")

    def align(batch: pa.RecordBatch):
        found: dict[tuple, list[int]] = {}
        for host, k, html, model in zip(*(batch.column(c).to_pylist() for c in ("host", "k", "html", "pattern")), strict=True):
            watched = pattern_texts(model)
            if watched:
                for a, b in match(pattern_tree(model), tree(html)):
                    if a.number in watched:
                        n = found.setdefault((host, k, a.number), [0, 0])
                        n[0] += 1
                        n[1] += same_line(a, b)
        rows = [(h, k, i, n, same) for (h, k, i), (n, same) in found.items()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "k", "node", "met", "same"])

    # equal pages first, dealt by content; the join is then free to split a large host
    differing = pages.select("host", "layout", "html").dropDuplicates(["html", "host"]).join(pattern, ["host", "layout"])
    met = common.map_batches(differing.select("host", "k", "html", "pattern"), align, "host string, k long, node int, met long, same long")
    fixed = met.groupBy("host", "k", "node").agg(F.sum("met").alias("met"), F.sum("same").alias("same")).where(
        (F.col("met") >= least_pages) & (F.col("same") >= share * F.col("met")))
    constant = common.staged(fixed.groupBy("host", "k").agg(
        F.sort_array(F.collect_list("node")).alias("constant")), "constants")  # a pattern's nodes at most
    return common.staged(pattern.join(constant, ["host", "k"]).select("host", "layout", "pattern", "constant"), "templates")


def main_text(pages: DataFrame, least_pages: int = 5, share: float = 0.9, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("layout", layout_of(F.col("html")))
    templates = induce(rows, least_pages, share)

    def extract(batch: pa.RecordBatch):
        out = []
        for html, pattern, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "pattern", "constant")), strict=True):
            root = tree(html)
            out.append(text_of(root, template_of(root, pattern, constant)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    return common.map_batches(rows.join(templates, ["host", "layout"], "left"), extract, "page_id long, url string, text string, n_chars long")
