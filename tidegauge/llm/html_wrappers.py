"""Main text of web pages by wrappers that are induced from the pages of each host.

A page becomes a tree of elements. Neighbouring elements of one label (tag and classes, without digits) are one node of a
slimmer tree, an iterator, so lists of any length align. Of every host, a page of the commonest shape is the reference. All
distinct pages of the host are aligned with it by simple tree matching, and for each node of the reference the pages with the
same text there are counted. Where nine tenths of at least three pages agree, the node is template; other nodes are slots.
A wrapper is the reference tree with these marks.

To extract, a page is aligned with its host's wrapper: template nodes go, slots become content. Slots that vary but are not
the article are told by their role: tags, roles and class names of menus, headers, footers, sidebars, adverts, notices, forms
and comments, and, on pages without an article or main element, blocks made of links. If a page has an article (or main)
element, only slots in it count. Headings and paragraphs of an article are always slots, and if nothing is left, template
nodes are kept, so copies of one article are not taken for template. Pages without host, and hosts of fewer than three
distinct pages, are judged by roles alone.

Every block's white space (as Unicode has it) becomes one space; blocks without text go; blocks are joined by a newline.
Character references are decoded. NULL and empty pages give an empty text; unclosed, stray and deeply nested elements are
borne; very long pages are read whole; repeated rows are extracted one by one; an empty table gives an empty result. Other
columns are kept by ``extract``.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.columns import free_name
from tidegauge.llm.url_trust import host_of
from tidegauge.session import stored

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                "header hgroup hr main menu nav ol p pre search section summary table ul".split())
_BLOCK = _CLOSES_P | set("body caption dd dt head html legend li option optgroup select tbody td tfoot th thead title tr textarea".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("tbody", "thead", "tfoot")}}
DEEPEST = 200

# What marks a part of a page that is not its article.
ASIDE_TAGS = set("aside button canvas datalist dialog footer form head iframe input label math menu nav noembed noframes noscript object "
                 "script search select style svg template textarea title xmp".split())
ASIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_WORDS = set("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
                  "pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip "
                  "social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADING_WORDS = set("banner header masthead".split())  # mark no aside inside an article
OTHERS_WORDS = set("comment comments disqus recommended related replies".split())  # mark an aside even around articles
OTHERS_TAGS = set("aside footer nav".split())
_ALWAYS_SLOTS = set("p h1 h2 h3 h4 h5 h6".split())  # in an article; else copies of one article would make them template


class Node:
    __slots__ = ("tag", "label", "aside", "heading", "children", "group", "mark", "size", "linked", "landmark", "others")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.children, self.group = tag, tag, [], -1
        self.aside, self.heading = tag in ASIDE_TAGS, tag == "header"
        self.landmark, self.others = tag in ("article", "main"), tag in OTHERS_TAGS
        if attributes and tag not in ("html", "body") and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        names = []
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values))
            if name in ("class", "id"):
                words = value.split()
                if name == "class":
                    names = sorted({re.sub(r"\d+", "", w) for w in words} - {""})
                said = {w.lower() for w in _WORD.findall(value)} & ASIDE_WORDS
                self.aside |= bool(said - HEADING_WORDS)
                self.heading |= bool(said & HEADING_WORDS)
                self.others |= bool(said & OTHERS_WORDS)
            elif name == "role":
                role = value.strip().lower()
                self.aside |= role in ASIDE_ROLES - HEADING_WORDS
                self.heading |= role in HEADING_WORDS
                self.landmark |= role in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.aside = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.aside = True
        if names:
            self.label = f"{self.tag}.{'.'.join(names)}"


def parse(page: str) -> Node:
    """The page's elements as a tree; texts are strings among the children, with character references decoded."""
    root = Node("html")
    stack, opened = [root], {"html": 1}

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if end:
            end = end.lower()
            if end == "br":
                stack[-1].children.append(Node("br"))
            elif opened.get(end) and end != "html":
                k = len(stack) - 1
                while stack[k].tag != end and (end in _BLOCK or stack[k].tag not in _BLOCK):
                    k -= 1
                if stack[k].tag == end and k:
                    close(k)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "html":
            continue
        if tag in _CLOSES_P and opened.get("p"):
            k = len(stack) - 1
            while k and stack[k].tag not in ("p", "td", "th", "button", "caption", "object"):
                k -= 1
            if stack[k].tag == "p":
                close(k)
        if tag in _ENDS:
            ended, bounds = _ENDS[tag]
            if any(opened.get(t) for t in ended):
                k, last = len(stack) - 1, 0
                while k and stack[k].tag not in bounds:
                    if stack[k].tag in ended:
                        last = k
                    k -= 1
                if last:
                    close(last)
        elif len(tag) == 2 and tag[0] == "h" and stack[-1].tag[:1] == "h" and len(stack[-1].tag) == 2 and stack[-1].tag != "hr":
            close(len(stack) - 1)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            m = _RAW[tag].search(page, at)
            stop = m.start() if m else size
            if tag == "textarea":
                node.children.append(page[at:stop])
            at = stop
            if m:
                at = page.find(">", m.end())
                at = size if at < 0 else at + 1
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def measure(root: Node) -> None:
    """Sets every node's mark (a hash of its words), the length of its text and of its text in links, and whether it holds a landmark."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if type(c) is Node)
    for node in reversed(order):
        mark, size, linked = 0, 0, 0
        for c in node.children:
            if type(c) is str:
                words = c.split()
                if words:
                    c = " ".join(words)
                    mark = (mark * 0x9E3779B1 + xxhash.xxh64_intdigest(c)) & 0x7FFFFFFFFFFFFFFF
                    size += len(c)
            elif c.size:
                mark = (mark * 0x9E3779B1 + c.mark) & 0x7FFFFFFFFFFFFFFF
                size, linked = size + c.size, linked + c.linked
                node.landmark = node.landmark or c.landmark
            else:
                node.landmark = node.landmark or c.landmark
        node.mark, node.size, node.linked = mark, size, size if node.tag == "a" else linked


class Slim:
    """A tree whose nodes stand for neighbouring elements of one label: depths, labels and marks in page order."""

    def __init__(self, depths: list[int], labels: list[str], marks: list[int]):
        self.depths, self.labels, self.marks = depths, labels, marks
        self.children: list[list[int]] = [[] for _ in depths]
        path: list[int] = []
        for k, d in enumerate(depths):
            del path[d:]
            if path:
                self.children[path[-1]].append(k)
            path.append(k)


def slim(root: Node) -> Slim:
    """The slim tree of a measured page; sets every element's place in it. Asides that cannot hold text are left out."""
    depths, labels, marks = [], [], []

    def visit(members: list[Node], depth: int) -> None:
        k = len(depths)
        mark = 0
        for m in members:
            m.group = k
            mark = (mark * 0x9E3779B1 + m.mark) & 0x7FFFFFFFFFFFFFFF if m.size else mark
        depths.append(depth)
        labels.append(members[0].label)
        marks.append(mark)
        groups: list[list[Node]] = []
        if len(members) == 1:
            for c in members[0].children:
                if type(c) is Node and c.size:
                    if groups and groups[-1][0].label == c.label:
                        groups[-1].append(c)
                    else:
                        groups.append([c])
        else:
            named: dict[str, list[Node]] = {}
            for m in members:
                for c in m.children:
                    if type(c) is Node and c.size:
                        named.setdefault(c.label, []).append(c)
            groups = list(named.values())
        for g in groups:
            visit(g, depth + 1)

    visit([root], 0)
    return Slim(depths, labels, marks)


def align(a: Slim, b: Slim) -> dict[int, int]:
    """Simple tree matching: nodes of ``a`` and the nodes of ``b`` they match, most nodes (and most equal texts) in all, order kept."""

    def match(i: int, j: int) -> tuple[int, list]:
        weight = 2 if a.marks[i] != b.marks[j] else 3
        own, other = a.children[i], b.children[j]
        if not own or not other:
            return weight, [(i, j)]
        found = {}
        best = [[0] * (len(other) + 1)]
        for x, c in enumerate(own):
            row, above = [0], best[-1]
            for y, d in enumerate(other):
                top = above[y + 1] if above[y + 1] >= row[y] else row[y]
                if a.labels[c] == b.labels[d]:
                    found[x, y] = match(c, d)
                    top = max(top, above[y] + found[x, y][0])
                row.append(top)
            best.append(row)
        pairs = [(i, j)]
        x, y = len(own), len(other)
        while x and y:
            here = best[x][y]
            if here == best[x - 1][y]:
                x -= 1
            elif here == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs += found[x, y][1]
        return weight + best[-1][-1], pairs

    return dict(match(0, 0)[1]) if a.labels and b.labels else {}


def blocks_of(root: Node, template: set[int], within: bool) -> list[str]:
    """The texts of the page's slots, block by block: those in landmarks only, if ``within``."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        words = "".join(buffer).split()
        buffer.clear()
        if words:
            out.append(" ".join(words))

    def visit(node: Node, inside: bool) -> None:
        if node.landmark and not inside:  # asides and template may stand around an article
            if node.others:
                return
        else:
            aside = node.aside and not (node.tag == "form" and 2 * node.size > root.size)  # some pages are one form
            if aside or (node.heading and not inside) or (node.group in template and not (inside and node.tag in _ALWAYS_SLOTS)):
                return
            if not within and node.tag in _BLOCK and node.size and 3 * node.linked > 2 * node.size:
                return
        own = node.tag == "article" or (node.landmark and not any(type(c) is Node and c.landmark for c in node.children))
        inside = inside or own
        block = node.tag in _BLOCK
        if block:
            flush()
        for c in node.children:
            if type(c) is str:
                if inside or not within:
                    buffer.append(c)
            elif c.tag == "br":
                buffer.append(" ")
            else:
                visit(c, inside)
        if block:
            flush()

    visit(root, False)
    flush()
    return out


def main_text(page: str, wrapper: Slim | None = None, constant: list[bool] | None = None) -> str:
    """The page's main text, given its host's wrapper, if there is one."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    template = set()
    if wrapper is not None:
        template = {k for k, ref in align(slim(root), wrapper).items() if constant[ref]}
    for within, gone in ((True, template), (True, set()), (False, template), (False, set())):
        if within and not root.landmark:
            continue
        out = blocks_of(root, gone, within)
        if out:
            return "\n".join(out)
    return ""


_TREE = "depths array<int>, labels array<string>, marks array<bigint>"


def trees(pages: DataFrame) -> DataFrame:
    """(host, page, shape, depths, labels, marks): the slim tree of every distinct page of a host."""

    def work(batches):
        for batch in batches:
            out = {c: [] for c in ("host", "page", "shape", "depths", "labels", "marks")}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                measure(root)
                tree = slim(root)
                shape = " ".join(f"{d}{label}" for d, label in zip(tree.depths, tree.labels, strict=True))
                for c, v in zip(out, (host, xxhash.xxh64_intdigest(page) >> 1, xxhash.xxh64_intdigest(shape) >> 1, tree.depths, tree.labels, tree.marks), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("shape", pa.int64()), ("depths", pa.list_(pa.int32())),
                        ("labels", pa.list_(pa.string())), ("marks", pa.list_(pa.int64()))])
    every = pages.where("_host <> '' and length(_html) > 0").select("_host", "_html").mapInArrow(work, f"host string, page bigint, shape bigint, {_TREE}")
    one = every.groupBy("host", "page").agg(F.min(F.struct("shape", "depths", "labels", "marks")).alias("t"))
    return one.select("host", "page", "t.*")


def _hot(rows: DataFrame, host: str, least: int = 10_000) -> list[str]:
    """Hosts with a thousandth of all rows or more: a thousand at most."""
    n = rows.groupBy(host).count()
    total = n.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in n.where(F.col("count") >= max(least, -(-total // 1000))).select(host).collect()]


SALTS = 256


def _salted(rows: DataFrame, host: str, hot: list[str], own) -> DataFrame:
    """With ``_salt``: hot hosts are dealt over many keys by the hash of ``own``."""
    return rows.withColumn("_salt", F.when(F.col(host).isin(hot), F.pmod(F.xxhash64(own), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0))


def _repeated(refs: DataFrame, hot: list[str]) -> DataFrame:
    """One row per host and salt."""
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return refs.withColumn("_salt", F.explode(F.when(F.col("host").isin(hot), salts).otherwise(F.array(F.lit(0))))) if hot else refs.withColumn("_salt", F.lit(0))


def induce(pages: DataFrame, agree: float = 0.9, least: int = 3) -> DataFrame:
    """(host, depths, labels, marks, constant): the wrapper of every host with at least ``least`` distinct pages.

    ``pages`` has the columns ``_host`` and ``_html``.
    """
    known = stored(trees(pages), "page-trees")
    shapes = known.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "depths", "labels", "marks")).alias("t"))
    refs = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "shape", "t")).alias("best")).where(F.col("pages") >= least)
    refs = stored(refs.select("host", *(F.col(f"best.t.{c}").alias(f"_{c}") for c in ("depths", "labels", "marks"))), "references")
    hot = _hot(known, "host")
    both = _salted(known, "host", hot, "page").join(_repeated(refs, hot), ["host", "_salt"]).select("host", "depths", "labels", "marks", "_depths", "_labels", "_marks")

    def work(batches):
        counts: dict[str, list] = {}

        def rows():
            flat = [(h, k, n, s) for h, own in counts.items() for k, (n, s) in enumerate(zip(*own[1:], strict=True)) if n]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*flat, strict=True) if flat else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "node", "aligned", "same"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["host"] not in counts:
                    size = len(r["_labels"])
                    counts[r["host"]] = [Slim(r["_depths"], r["_labels"], r["_marks"]), [0] * size, [0] * size]
                ref, aligned, same = counts[r["host"]]
                for k, at in align(Slim(r["depths"], r["labels"], r["marks"]), ref).items():
                    aligned[at] += 1
                    same[at] += r["marks"][k] == ref.marks[at]
            if len(counts) > 10_000:
                yield rows()
        yield rows()

    nodes = both.mapInArrow(work, "host string, node int, aligned bigint, same bigint").groupBy("host", "node").agg(
        F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    constant = (F.col("aligned") >= least) & (F.col("same") >= agree * F.col("aligned"))
    marked = nodes.where(constant).groupBy("host").agg(F.collect_set("node").alias("_nodes"))
    flags = F.transform(F.sequence(F.lit(0), F.size("_labels") - 1), lambda k: F.coalesce(F.array_contains("_nodes", k), F.lit(False)))
    return refs.join(marked, "host", "left").select("host", "_depths", "_labels", "_marks", flags.alias("_constant"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", agree: float = 0.9, least: int = 3) -> DataFrame:
    """``pages`` with ``text_col``, the main text of every page (it replaces a column of this name)."""
    kept = [c for c in pages.columns if c.lower() != text_col.lower()]
    taken = pages.columns
    own = {c: free_name(taken, f"_page_{k}") for k, c in enumerate(taken)}
    rows = pages.select(*(F.col(f"`{c}`").alias(own[c]) for c in taken), host_of(F.col(f"`{url_col}`")).alias("_host"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    wrappers = stored(induce(rows, agree, least), "wrappers")
    hot = _hot(rows, "_host")
    both = _salted(rows, "_host", hot, "_html").join(_repeated(wrappers, hot).withColumnRenamed("host", "_host"), ["_host", "_salt"], "left")
    names = [own[c] for c in kept]
    both = both.select(*names, "_host", "_html", "_depths", "_labels", "_marks", "_constant")
    schema = T.StructType([both.schema[c] for c in names]).add("_text", T.StringType())

    def work(batches):
        held: tuple = (None, None, None)
        for batch in batches:
            column = {c: batch.column(c) for c in ("_host", "_html", "_depths", "_labels", "_marks", "_constant")}
            texts = []
            for k, (host, page) in enumerate(zip(column["_host"].to_pylist(), column["_html"].to_pylist(), strict=True)):
                if host != held[0] or not host:
                    if column["_labels"][k].is_valid:
                        depths, labels, marks, constant = (column[c][k].as_py() for c in ("_depths", "_labels", "_marks", "_constant"))
                        held = host, Slim(depths, labels, marks), constant
                    else:
                        held = host, None, None
                texts.append(main_text(page or "", held[1], held[2]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], schema.names)

    out = both.mapInArrow(work, schema)
    return out.select(*(F.col(own[c]).alias(c) for c in kept), F.col("_text").alias(text_col))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
