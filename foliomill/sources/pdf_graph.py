"""The parts of a PDF file's object graph that images and outlines hang on, as rows.

Rows tell what objects say, nothing more: pages, which object links to which, image streams, outline items.  What follows
from them is done by operators.graphs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources.containers import scan
from foliomill.sources.pdf import NO_TITLE, Pdf, Ref, Stream, text_string

GRAPH = ("kind string, node int, page int, target int, title string, first int, next int, width int, height int, filter string, n_bytes long, sha256 string")
FIELDS = [f.split()[0] for f in GRAPH.split(", ")]


def _row(kind: str, node: int, **values) -> tuple:
    return tuple({"kind": kind, "node": node, **values}.get(f) for f in FIELDS)


def _number(value) -> int | None:
    return value[0] if isinstance(value, Ref) else None


def _drawn(pdf: Pdf, attrs: dict) -> Iterator[int]:
    """The objects that resources name as drawings."""
    resources = pdf.get(attrs.get("Resources"))
    found = pdf.get(resources.get("XObject")) if isinstance(resources, dict) else None
    if isinstance(found, dict):
        yield from (n for v in found.values() if (n := _number(v)) is not None)


def graph(content: bytes) -> Iterator[tuple]:
    """Rows of kind page (node, page), link (node, target), image (node, width, height, filter, n_bytes, sha256 of the stored bytes), item (node, title, first, next) and destination (node, target).

    The outline's root is item 0.  Named destinations give none.
    """
    pdf = Pdf(content)
    for page, (ref, _) in enumerate(pdf.pages(), 1):
        if ref is not None:
            yield _row("page", ref[0], page=page)
    root = pdf.get(pdf.trailer.get("Root"))
    top = pdf.get(root.get("Outlines")) if isinstance(root, dict) else None
    if isinstance(top, dict):
        yield _row("item", 0, first=_number(top.get("First")))
    whole = lambda attrs, key: v if isinstance(v := pdf.get(attrs.get(key)), int) else None
    for node in sorted(pdf.places):
        found = pdf.get(Ref((node, 0)))
        attrs = found.attrs if isinstance(found, Stream) else found
        if not isinstance(attrs, dict):
            continue
        kind = str(pdf.get(attrs.get("Subtype")) or "").lower()
        if isinstance(found, Stream) and (kind == "image" or {"Width", "Height"} <= attrs.keys()):
            filters = pdf.get(attrs.get("Filter"))
            names = [str(pdf.get(f)) for f in (filters if isinstance(filters, list) else [filters]) if f is not None]
            yield _row("image", node, width=whole(attrs, "Width"), height=whole(attrs, "Height"), filter=",".join(names) or None, n_bytes=len(found.raw), sha256=hashlib.sha256(found.raw).hexdigest())
        elif kind == "form" or attrs.get("Type") in ("Page", "Pages"):
            for target in _drawn(pdf, attrs):
                yield _row("link", node, target=target)
            if (up := _number(attrs.get("Parent"))) is not None and not isinstance(found, Stream):
                yield _row("link", node, target=up)
        elif "Title" in attrs and ("Parent" in attrs or "Next" in attrs or "Prev" in attrs):
            title = pdf.get(attrs.get("Title"))
            yield _row("item", node, title=text_string(title) if isinstance(title, bytes) else NO_TITLE, first=_number(attrs.get("First")), next=_number(attrs.get("Next")))
            action = pdf.get(attrs.get("A"))
            to = attrs.get("Dest", action.get("D") if isinstance(action, dict) else None)
            to = to if isinstance(pdf.get(to), dict) else pdf.get(to)  # a page itself, or an array that begins with one
            target = _number(to[0] if isinstance(to, list) and to else to)
            if target is not None:
                yield _row("destination", node, target=target)


def read_graph(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> dict[str, DataFrame]:
    """The relations of the graph by kind, each with doc_id, the file's path; `errors` has the files that can't be read."""
    rows = scan(spark, path, graph, GRAPH, "*.pdf", mode).withColumnRenamed("path", "doc_id").persist()
    own = lambda kind, *columns: rows.where(F.col("kind") == kind).select("doc_id", "node", *columns)
    return {"pages": own("page", "page"), "links": own("link", "target"), "images": own("image", "width", "height", "filter", "n_bytes", "sha256"), "items": own("item", "title", "first", "next"),
            "destinations": own("destination", F.col("target").alias("page_node")), "errors": rows.where("kind IS NULL").select("doc_id", "error", "error_type")}
