"""Operators over pages (page_id, url, html): articles, links, tables, cards, Markdown, routing.

A page is parsed once, in Arrow batches, into its nodes in the order of the page: elements and pieces of text,
each with the interval of nodes below it.  Titles, links, tables, cards and articles are native expressions over
these nodes: a selector is a filter, "below" is a slice, an ancestor is an interval that holds another.  Null html is an
empty page, a null or broken url has no address to join with, and rows of one page_id are taken as
pages of their own.  Only the article as HTML and as Markdown is written by the parser's own tree.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from foliomill.functions import text as T
from foliomill.sources import html as H
from foliomill.sources.containers import BROKEN, MODES, error_type

# Content containers by priority, noise, and where author and date stand.
CONTENT = [
    "#js_content", "article", "main article", "#article-content", ".article-content", ".post-content", ".entry-content", "#content", ".content",
    "#main-content", ".main-content", ".detail-content", ".text", "main",
]
NOISE = [
    "script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", ".ad", ".advertisement", ".share-box", ".qrcode", "#js_toobar3",
    ".reward_area", ".rich_media_area_extra",
]
AUTHOR = ["meta[name='author']", "meta[property='article:author']", ".rich_media_meta_text"]
DATE = ["meta[property='article:published_time']", "meta[name='pubdate']", "meta[name='publishdate']", "#publish_time", ".publish-time", ".time"]
TITLE = ["#activity-name", "h1", "title"]
NO_TITLE = "未命名网页"
NOT_LINKS = ("#", "javascript:", "mailto:", "tel:")
USABLE = rf"^[\s\u001c-\u001f\u0085\p{{Z}}]*(?!{'|'.join(NOT_LINKS)})[^\s\u001c-\u001f\u0085\p{{Z}}]"
# Fixed values of the router.
MEDIA_PARTS, MEDIA_ENDS = ("bilibili.com", "youtube.com", "youtu.be"), (".mp4", ".mkv", ".flv")
BINARY_ENDS = ("xlsx", "xls", "doc", "docx", "pdf", "zip", "rar", "7z", "tar", "gz", "png", "jpg", "jpeg", "gif", "webp", "csv", "exe", "bin")

#: Characters of html whose nodes, or of results, that a worker holds before it hands them on.
HELD = 1 << 19

_selectors: dict[str, H.Selector] = {}


def _css(css: str) -> H.Selector:
    if css not in _selectors:
        _selectors[css] = H.Selector(css)
    return _selectors[css]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds the nodes of few pages at a time; what it has freed goes back to the system."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _parsed(pages: DataFrame, rows: Callable[[H.Node, str], Iterator[tuple]], ddl: str, mode: str | None = None, closed: bool = False) -> DataFrame:
    """page_id and the columns of `ddl` for each tuple that `rows` gives for a page's tree and url.

    mode: None and DROPMALFORMED give no row for a page that can't be read, PERMISSIVE a row with `error`
    and `error_type` (columns that it adds), FAILFAST ends the job.  `closed` is that of html.parse.
    """
    if mode not in (None, *MODES):
        raise ValueError(f"not a mode: {mode!r}")
    id_type, fields, told = pages.schema["page_id"].dataType, ST.StructType.fromDDL(ddl).fields, mode == "PERMISSIVE"
    errors = [ST.StructField(c, ST.StringType()) for c in ("error", "error_type")] if told else []
    schema = ST.StructType([ST.StructField("page_id", id_type), *fields, *errors])
    arrow = to_arrow_schema(schema)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    def run(batches):
        for b in _small(batches):
            held, size = [], 0
            for key, url, page in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    found = list(rows(H.parse(page or "", closed), url or ""))  # whole or not at all
                    found = [(*row, None, None) for row in found] if told else found
                except BROKEN as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"page {key}: {e}") from e
                    found = [(*[None] * len(fields), f"{type(e).__name__}: {e}", error_type(e))] if told else []
                for row in found:
                    held.append((key, *row))
                    size += sum(len(x) for x in row if isinstance(x, str))
                    if len(held) >= 4096 or size > HELD:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select("page_id", url.alias("url"), "html").mapInArrow(run, schema)


NODES = "at:int,last:int,parent:int,tag:string,attrs:map<string,string>,address:string,text:string"


def _flat(tree: H.Node, url: str, out: dict[str, list]) -> int:
    """Append the nodes of a page to the columns of `out`; how many there are."""
    begin = len(out["tag"])
    stack: list[tuple[H.Node | str, int]] = [(tree, -1)]
    while stack:
        node, parent = stack.pop()
        at = len(out["tag"]) - begin
        out["at"].append(at)
        out["last"].append(at)
        out["parent"].append(parent)
        if isinstance(node, str):
            out["tag"].append(None)
            out["attrs"].append(None)
            out["address"].append(None)
            out["text"].append(node)
            continue
        href = node.attrs.get("href") if node.tag == "a" else node.attrs.get("src", node.attrs.get("data-src")) if node.tag == "img" else None
        out["tag"].append(node.tag)
        out["attrs"].append(list(node.attrs.items()))
        out["address"].append(None if href is None else H.join(url, href.strip()))
        out["text"].append(None)
        stack.extend((c, at) for c in reversed(node.children))
    last, parents = out["last"], out["parent"]
    for i in range(len(last) - 1, begin, -1):
        up = begin + parents[i]
        last[up] = max(last[up], last[i])
    return len(last) - begin


def nodes(pages: DataFrame, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, nodes): the nodes of each page, the root first.

    A node has its place `at`, the place `last` of the last node below it, its `parent`'s place, and either a tag, its
    attributes and the whole `address` of a link or image, or a piece of text.  `mode` and `closed` are those of `_parsed`.
    """
    if mode not in (None, *MODES):
        raise ValueError(f"not a mode: {mode!r}")
    told = mode == "PERMISSIVE"
    errors = [ST.StructField(c, ST.StringType()) for c in ("error", "error_type")] if told else []
    schema = ST.StructType([ST.StructField("page_id", pages.schema["page_id"].dataType), *ST.StructType.fromDDL(f"nodes array<struct<{NODES}>>").fields, *errors])
    arrow = to_arrow_schema(schema)
    kinds = arrow.field("nodes").type.value_type

    def batch(keys: list, held: dict[str, list], sizes: list[int | None], faults: list) -> pa.RecordBatch:
        flat = pa.StructArray.from_arrays([pa.array(held[f.name], f.type) for f in kinds], fields=list(kinds))
        offsets = [0]
        for n in sizes:
            offsets.append(offsets[-1] + (n or 0))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([n is None for n in sizes], pa.bool_()))
        columns = [pa.array(keys, arrow.field("page_id").type), lists.cast(arrow.field("nodes").type)]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(c, pa.string()) for c in zip(*faults)] if told else [])], schema=arrow)

    def run(batches):
        for b in _small(batches):
            keys, sizes, faults, held, size = [], [], [], {f.name: [] for f in kinds}, 0
            for key, url, page in zip(*(b.column(i).to_pylist() for i in range(3))):
                begin = len(held["tag"])
                try:
                    sizes.append(_flat(H.parse(page or "", closed), url or "", held))
                    faults.append((None, None))
                except BROKEN as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"page {key}: {e}") from e
                    for column in held.values():
                        del column[begin:]
                    if not told:
                        continue
                    sizes.append(None)
                    faults.append((f"{type(e).__name__}: {e}", error_type(e)))
                keys.append(key)
                size += len(page or "")
                if size > HELD:
                    yield batch(keys, held, sizes, faults)
                    keys, sizes, faults, held, size = [], [], [], {f.name: [] for f in kinds}, 0
            if keys:
                yield batch(keys, held, sizes, faults)

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select("page_id", url.alias("url"), "html").mapInArrow(run, schema)


def below(node: Column) -> Column:
    """The nodes below one."""
    return F.slice("nodes", node["at"] + 2, node["last"] - node["at"])


def text_of(node: Column) -> Column:
    """The text below a node."""
    return F.array_join(F.transform(below(node), lambda n: n["text"]), "")


def fits(css: str) -> Callable[[Column], Column]:
    """A CSS selector as a condition on a node."""
    chains = H.Selector(css).chains

    def compound(test: H.Compound, n: Column) -> Column:
        out = n["tag"].isNotNull() if test.tag is None else n["tag"].eqNullSafe(test.tag)
        for name, op, want in test.tests:
            have, some = F.try_element_at(n["attrs"], F.lit(name)), F.lit(bool(want))
            ok = {"": have.isNotNull(), "=": have == want, "~=": F.array_contains(F.split(have, "[ \\t-\\r]+"), want), "^=": some & have.startswith(want), "$=": some & have.endswith(want),
                  "*=": some & F.contains(have, F.lit(want)), "|=": (have == want) | have.startswith(want + "-")}[op]
            out = out & F.coalesce(ok, F.lit(False))
        return out

    def chain(parts: list, i: int, n: Column) -> Column:
        out = compound(parts[i][1], n)
        if i and parts[i][0] == ">":
            return out & F.coalesce(T.let(F.get("nodes", n["parent"]), lambda up: chain(parts, i - 1, up)), F.lit(False))
        if i:
            return out & F.exists("nodes", lambda up: (up["at"] < n["at"]) & (up["last"] >= n["last"]) & chain(parts, i - 1, up))
        return out

    return lambda n: functools.reduce(lambda a, b: a | b, (chain(c, len(c) - 1, n) for c in chains))


def select(css: str) -> Column:
    return F.filter("nodes", fits(css))


def _exploded(found: DataFrame, rows: Column, at: str, value: str) -> DataFrame:
    """A row for each of `rows` with its place; pages that couldn't be read keep their error row."""
    if "error" not in found.columns:
        return found.select("page_id", F.posexplode(rows).alias(at, value))
    return found.select("page_id", "error", "error_type", F.posexplode_outer(rows).alias(at, value)).where(F.col(at).isNotNull() | F.col("error").isNotNull())


def _errors(found: DataFrame) -> list[str]:
    return [c for c in ("error", "error_type") if c in found.columns]


def links(pages: DataFrame, limit: int | None = None, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, index, title, url, date): anchors in order, one for each address, then titles of two characters at least.

    The first anchor of an address counts even if its title is too short.  The date is looked for
    in the text of the anchor's parent, then in its own.
    """
    href = lambda n: F.try_element_at(n["attrs"], F.lit("href"))
    anchors = F.filter("nodes", lambda n: n["tag"].eqNullSafe("a") & n["address"].isNotNull() & href(n).rlike(USABLE))
    by_address = F.array_sort(F.transform(anchors, lambda n: F.struct(n["address"].alias("address"), n["at"].alias("at"))))
    first = lambda all_: F.filter(all_, lambda e, i: (i == 0) | ~F.get(all_, i - 1)["address"].eqNullSafe(e["address"]))
    in_order = F.array_sort(F.transform(T.let(by_address, first), lambda e: e["at"]))
    titled = F.transform(in_order, lambda at: T.let(F.get("nodes", at), lambda n: F.struct(at.alias("at"), T.utrim(text_of(n)).alias("title"), n["address"].alias("url"))))
    kept = F.filter(titled, lambda t: F.length(t["title"]) >= 2)
    found = nodes(pages, mode, closed).withColumn("_links", kept if limit is None else F.slice(kept, 1, limit))
    own = lambda t: F.get("nodes", t["at"])
    rows = F.transform("_links", lambda t: F.struct(t["title"], t["url"], text_of(F.get("nodes", own(t)["parent"])).alias("around"), text_of(own(t)).alias("own")))
    out = _exploded(found, rows, "_at", "_l")
    date = F.coalesce(T.find_date(F.col("_l.around")), F.when(F.col("_l.own") != F.col("_l.around"), T.find_date(F.col("_l.own"))))
    return out.select("page_id", (F.col("_at") + 1).alias("index"), "_l.title", "_l.url", date.alias("date"), *_errors(out))


def _title(tree: H.Node) -> str:
    for css in TITLE:
        node = tree.first(_css(css))
        if node is not None and node.text().strip():
            return node.text().strip()
    return NO_TITLE


def _meta(tree: H.Node, selectors: list[str]) -> str | None:
    """The first element of each selector in turn: a meta's content, else the text."""
    for css in selectors:
        node = tree.first(_css(css))
        value = "" if node is None else node.attrs.get("content", "") if css.startswith("meta") else node.text()
        if value.strip():
            return value.strip()
    return None


def title_of() -> Column:
    tried = [T.utrim(text_of(F.get(select(css), F.lit(0)))) for css in TITLE]
    return F.coalesce(*[F.when(t != "", t) for t in tried], F.lit(NO_TITLE))


def meta_of(selectors: list[str]) -> Column:
    """Of the first element of each selector, in turn, a meta's content, else the text."""
    first = lambda css: F.get(select(css), F.lit(0))
    tried = [T.utrim(F.try_element_at(first(css)["attrs"], F.lit("content")) if css.startswith("meta") else text_of(first(css))) for css in selectors]
    return F.coalesce(*[F.when(t != "", t) for t in tried])


def titles(pages: DataFrame, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, title): the first of three places with text, else a default."""
    found = nodes(pages, mode, closed)
    return found.select("page_id", F.when(F.col("nodes").isNotNull(), title_of()).alias("title"), *_errors(found))


def metas(pages: DataFrame, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, author, publish_date), null where a page names none."""
    found = nodes(pages, mode, closed)
    return found.select("page_id", meta_of(AUTHOR).alias("author"), meta_of(DATE).alias("publish_date"), *_errors(found))


def _article(tree: H.Node, url: str, least: int) -> H.Node:
    """The content container without noise, with absolute addresses; it changes the tree."""
    chosen = None
    for css in CONTENT:
        node = tree.first(_css(css))
        if node is not None and len(node.text().strip()) > least:
            chosen = node
            break
    chosen = chosen or tree.first(_css("body"))
    for css in NOISE:
        chosen.drop(_css(css))
        if _css(css).fits(chosen):
            chosen.children = []
    for n in chosen.walk():
        if "data-src" in n.attrs:
            n.attrs["src"] = n.attrs.pop("data-src")
        name = {"img": "src", "a": "href"}.get(n.tag)
        value = n.attrs.get(name, "").strip() if name else ""
        keep = ("http://", "https://", "#", "javascript:", *(("data:",) if name == "src" else ("mailto:", "tel:")))
        if value and value != "/" and not value.startswith(keep):
            n.attrs[name] = H.join(url, value) or value
    return chosen


def article_text(pages: DataFrame, least: int = 30, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, text): the text of the first content container with more than `least` characters, else the body's, without noise."""
    enough = lambda css: T.let(F.get(select(css), F.lit(0)), lambda n: F.when(F.length(T.utrim(text_of(n))) > least, n))
    found = nodes(pages, mode, closed).withColumn("_chosen", F.coalesce(*map(enough, CONTENT), F.get(select("body"), F.lit(0))))
    noise = fits(", ".join(NOISE))
    found = found.withColumn("_noise", F.filter(F.slice("nodes", F.col("_chosen.at") + 1, F.col("_chosen.last") - F.col("_chosen.at") + 1), noise))
    clean = F.filter(below(F.col("_chosen")), lambda n: n["text"].isNotNull() & ~F.exists("_noise", lambda x: n["at"].between(x["at"], x["last"])))
    return found.select("page_id", T.utrim(F.array_join(F.transform(clean, lambda n: n["text"]), "")).alias("text"), *_errors(found))


def articles(pages: DataFrame, least: int = 30, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, title, author, publish_date, clean_html)."""
    rows = lambda tree, url: iter([(_title(tree), _meta(tree, AUTHOR), _meta(tree, DATE), _article(tree, url, least).html())])
    return _parsed(pages, rows, "title string, author string, publish_date string, clean_html string", mode, closed)


BLOCKS = frozenset("address article aside blockquote body div dl dd dt fieldset figure figcaption footer form header main nav ol p section ul".split())


def _walked(step: Callable[[H.Node], Generator], node: H.Node):
    """What `step` returns for a node; where it yields a child, it gets what `step` returns for that child.  The depth of a page is no depth of calls."""
    stack, value = [step(node)], None
    while stack:
        try:
            child = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(step(child))
            value = None
    return value


def _line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _inline_steps(node: H.Node) -> Generator:
    parts = []
    for c in node.children:
        parts.append(_line(c) if isinstance(c, str) else (yield c))
    inner = "".join(parts)
    bare = inner.strip()
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if not bare:
        return inner
    if node.tag in ("b", "strong"):
        return f"**{bare}**"
    if node.tag in ("i", "em"):
        return f"*{bare}*"
    if node.tag == "code":
        return f"`{bare}`"
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{bare}]({node.attrs['href']})"
    return inner


def _inline(node: H.Node | str) -> str:
    return _line(node) if isinstance(node, str) else _walked(_inline_steps, node)


def _content(node: H.Node) -> str:
    """The children of a node as one line."""
    return _line("".join(map(_inline, node.children))).strip()


HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
OWN_BLOCKS = BLOCKS | HEADINGS | {"pre", "table", "hr", "li"}


def _block_holders(root: H.Node) -> set[int]:
    """The nodes below `root` that have a block below them."""
    out: set[int] = set()
    for n in root.walk():
        if n.tag in BLOCKS or n.tag == "table":
            up = n.parent
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def _blocks(root: H.Node) -> list[str]:
    """Markdown blocks below a node: headings, lists, quotes, code, tables and paragraphs."""
    holders = _block_holders(root)

    def steps(node: H.Node) -> Generator:
        out, run = [], []

        def paragraph() -> None:
            text = "\n".join(line.strip(" ") + ("  " if line.endswith("  ") and line.strip() else "") for line in "".join(run).split("\n")).strip()
            run.clear()
            if text:
                out.append(text)

        inside = [iter(node.children)]  # of this node, and of plain containers that were entered
        while inside:
            c = next(inside[-1], None)
            if c is None:
                paragraph()
                inside.pop()
            elif isinstance(c, str) or not (c.tag in OWN_BLOCKS or id(c) in holders):
                run.append(_inline(c))
            else:
                paragraph()
                if c.tag in HEADINGS:
                    if head := _content(c):
                        out.append("#" * int(c.tag[1]) + " " + head)
                elif c.tag == "hr":
                    out.append("---")
                elif c.tag == "pre":
                    out.append("```\n" + c.text().strip("\n") + "\n```")
                elif c.tag == "table":
                    rows = [[_content(cell) for cell in tr.children if isinstance(cell, H.Node) and cell.tag in ("td", "th")] for tr in c.select(_css("tr"))]
                    rows = [r for r in rows if r]
                    if rows:
                        out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join(["---"] * len(rows[0])) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
                elif c.tag in ("ul", "ol"):
                    lines = []
                    for i, item in enumerate(k for k in c.children if isinstance(k, H.Node)):
                        mark = f"{i + 1}. " if c.tag == "ol" else "- "
                        lines.append(mark + "\n".join((yield item)).replace("\n", "\n" + " " * len(mark)))
                    if lines:
                        out.append("\n".join(lines))
                elif c.tag == "blockquote":
                    out.append("\n".join("> " + line for line in "\n\n".join((yield c)).split("\n")))
                else:
                    inside.append(iter(c.children))
        return out

    return _walked(steps, root)


def _markdown(tree: H.Node, url: str, least: int) -> str:
    title, author, date = _title(tree), _meta(tree, AUTHOR), _meta(tree, DATE)
    head = f"# {title}\n\n" + (f"**作者**：{author}  \n" if author else "") + (f"**发布时间**：{date}  \n" if date else "") + ("\n---\n\n" if author or date else "")
    return head + "\n\n".join(_blocks(_article(tree, url, least)))


def markdown(pages: DataFrame, least: int = 30, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, title, content): the article as Markdown under its title, author and date.

    Headings, paragraphs, lists, quotes, code, tables, links, images, bold and italic text are
    kept; all other markup gives its text.
    """
    return _parsed(pages, lambda tree, url: iter([(_title(tree), _markdown(tree, url, least))]), "title string, content string", mode, closed)


def tables(pages: DataFrame, limit: int | None = None, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, table_idx, row_idx, row): cells keyed by their header or col_N.

    All header cells of a table name its columns in order; of equal names the last cell stays.
    Tables without cells are skipped; a nested table is in its parent's rows and a table of its own.
    """
    inside = lambda n, tag: F.filter(below(n), lambda x: x["tag"].eqNullSafe(tag))
    texts = lambda n, tag: F.transform(inside(n, tag), lambda x: T.utrim(text_of(x)))
    lines = lambda t: F.filter(F.transform(inside(t, "tr"), lambda tr: texts(tr, "td")), lambda cells: F.size(cells) > 0)
    whole = F.transform(F.filter("nodes", lambda n: n["tag"].eqNullSafe("table")), lambda t: F.struct(texts(t, "th").alias("heads"), lines(t).alias("lines")))
    some = F.filter(whole, lambda t: F.size(t["lines"]) > 0)
    per_table = _exploded(nodes(pages, mode, closed), some if limit is None else F.slice(some, 1, limit), "table_idx", "_t")
    told = _errors(per_table)
    explode = F.posexplode_outer if told else F.posexplode
    cells = per_table.select("page_id", "table_idx", F.col("_t.heads").alias("_heads"), explode("_t.lines").alias("row_idx", "_cells"), *told)
    name = lambda i: F.coalesce(F.get("_heads", i), F.concat(F.lit("col_"), (i + 1).cast("string")))
    named = F.array_sort(F.transform("_cells", lambda c, i: F.struct(name(i).alias("k"), (-i).alias("i"), c.alias("v"))))  # the last of equal names first
    row = T.let(named, lambda all_: F.map_from_entries(F.transform(
        F.filter(all_, lambda e, i: (i == 0) | (F.get(all_, i - 1)["k"] != e["k"])), lambda e: F.struct(e["k"], e["v"]))))
    return cells.select("page_id", "table_idx", "row_idx", row.alias("row"), *told)


def cards(pages: DataFrame, selector: str, limit: int | None = None, mode: str | None = None, closed: bool = False) -> DataFrame:
    """(page_id, index, title, link, image_url, raw_text) of each element that the selector fits.

    The title is the first text of a card, which may be blank; a card without text is Item_N.
    """
    chosen = select(selector)  # a broken selector is an error before anything runs
    first = lambda n, tag: F.get(F.filter(below(n), lambda x: x["tag"].eqNullSafe(tag)), F.lit(0))["address"]
    texts = lambda n: F.filter(F.transform(below(n), lambda x: x["text"]), lambda t: t.isNotNull())
    rows = F.transform(chosen if limit is None else F.slice(chosen, 1, limit), lambda n: F.struct(first(n, "a").alias("link"), first(n, "img").alias("image_url"), texts(n).alias("texts")))
    out = _exploded(nodes(pages, mode, closed), rows, "_at", "_c")
    title = F.coalesce(T.utrim(F.get("_c.texts", F.lit(0))), F.concat(F.lit("Item_"), (F.col("_at") + 1).cast("string")))
    return out.select("page_id", (F.col("_at") + 1).alias("index"), title.alias("title"), "_c.link", "_c.image_url", T.utrim(F.array_join("_c.texts", " ")).alias("raw_text"), *_errors(out))


def route(url: Column, output: Column, form: Column | None = None) -> Column:
    """Which engine a download goes to: media by form or url, then binary and html by form or the output's extension, else Markdown."""
    low, form = F.lower(url), F.coalesce(form if form is not None else F.lit(None).cast("string"), F.lit(""))
    end = F.lower(F.regexp_extract(F.regexp_extract(output, r"([^/]*)/*$", 1), r"(?s)^.+\.([^.]*)$", 1))
    media = F.lower(form).isin("video", "audio")
    for part in MEDIA_PARTS:
        media = media | F.contains(low, F.lit(part))
    for part in MEDIA_ENDS:
        media = media | F.endswith(low, F.lit(part))
    return (F.when(media, "yt-dlp").when(form.isin("bin", "raw") | end.isin(*BINARY_ENDS), "aria2c")
            .when((form == "html") | end.isin("html", "htm"), "monolith").otherwise("markdown"))
