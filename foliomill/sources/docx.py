"""Word containers as relations: paragraphs, runs, table cells and styles."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import Element

from pyspark.sql import DataFrame, SparkSession

from foliomill.sources.containers import Package, everything, scan

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN, STYLES, RELATIONS = "word/document.xml", "word/styles.xml", "word/_rels/document.xml.rels"
#: Papers in twentieths of a point.
PAPERS = (("A4", 16838, 11906), ("A3", 23811, 16838), ("Letter", 15840, 12240))

PARAGRAPHS = "para_idx int, style_id string, text string"
RUNS = "para_idx int, run_ord int, text string, highlight string, page_break boolean"
TABLE_CELLS = "table_idx int, row int, col int, text string"
STYLE_ROWS = "id string, name string, style_type string, is_default boolean"
IMAGES = "img_idx int, rel_id string, width_mm double, height_mm double"
RELATION_ROWS = "rel_id string, target string"
SUMMARY = "total_paragraphs int, total_tables int, total_images int, total_highlights int, total_sections int, page_orientation string, page_size string"


def _text(node: Element) -> str:
    """The text below a node; tabs and line breaks as characters, page breaks as nothing."""
    out = []
    for n in node.iter():
        if n.tag == W + "t":
            out.append(n.text or "")
        elif n.tag == W + "tab" and "".join(n.attrib) == "":  # a tab stop's definition has attributes
            out.append("\t")
        elif n.tag == W + "br" and n.get(W + "type", "textWrapping") == "textWrapping":
            out.append("\n")
    return "".join(out)


def _body(content: bytes | Package) -> Element:
    """The body without self-closed paragraphs, which have no ordinal."""
    body = Package.of(content).xml(MAIN, lambda raw: re.sub(rb"<w:p(\s[^<>]*)?/>", b"", raw)).find(W + "body")
    if body is None:
        raise ValueError("no body")
    return body


def paragraphs(content: bytes | Package) -> Iterator[tuple]:
    """Paragraphs of the body in order, those in tables among them; split runs are joined."""
    for i, p in enumerate(_body(content).iter(W + "p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        yield i, None if style is None else style.get(W + "val"), _text(p)


def runs(content: bytes | Package) -> Iterator[tuple]:
    """Runs of the body's paragraphs with their highlight colour and whether a page break is in them."""
    for i, p in enumerate(_body(content).iter(W + "p")):
        for k, r in enumerate(p.iter(W + "r")):
            mark = r.find(f"{W}rPr/{W}highlight")
            broken = any(b.get(W + "type") == "page" for b in r.iter(W + "br"))
            yield i, k, _text(r), None if mark is None else mark.get(W + "val"), broken


def _local(node: Element) -> str:
    return node.tag.rpartition("}")[2]


def images(content: bytes | Package) -> Iterator[tuple]:
    """(img_idx, rel_id, width_mm, height_mm) of drawings with a size; a picture belongs to the last drawing that has none yet."""
    found: list[list] = []
    for n in _body(content).iter():
        if _local(n) == "extent":
            w, h = (_mm(n.get(k, "")) for k in ("cx", "cy"))
            if w > 0 and h > 0:
                found.append(["", w, h])
        elif _local(n) == "blip":
            rel = next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == "embed"), None)
            if rel is not None and found and not found[-1][0]:
                found[-1][0] = rel
    for i, row in enumerate(found):
        yield i, *row


def _mm(emu: str) -> float:
    """English metric units as millimetres to a tenth, half up; 0 for what is no number."""
    try:
        return math.floor(float(emu) / 36000.0 * 10.0 + 0.5) / 10.0
    except ValueError:
        return 0.0


def relations(content: bytes | Package) -> Iterator[tuple]:
    """(rel_id, target) of the document's relations."""
    package = Package.of(content)
    if package.has(RELATIONS):
        for n in package.xml(RELATIONS).iter():
            if _local(n) == "Relationship" and n.get("Id") and n.get("Target"):
                yield n.get("Id"), n.get("Target")


def media(content: bytes | Package, wanted: Callable[[str, object], bool] = everything) -> Iterator[tuple]:
    """(name, content) of every wanted file below word/media/."""
    package = Package.of(content)
    for name in package.names():
        own = name.rpartition("/")[2]
        if name.startswith("word/media/") and own and wanted("name", own):
            yield own, package.read(name)


def summary(content: bytes | Package) -> Iterator[tuple]:
    """Counts of a document, and the paper of its sections: the last size, and landscape once a section is wider than high or says so."""
    content = Package.of(content)
    body = _body(content)
    marked = sum(1 for r in runs(content) if r[3] is not None and r[2].strip())
    orientation, size = "portrait", "A4"
    for n in body.iter(W + "pgSz"):
        orientation = n.get(W + "orient", orientation)
        w, h = (int(v) if (v := n.get(W + k, "")).isdigit() else 0 for k in ("w", "h"))
        if orientation == "portrait" and w > h > 0:
            orientation = "landscape"
        near = lambda a, b: abs(max(w, h) - a) < 100 and abs(min(w, h) - b) < 100
        size = next((name for name, a, b in PAPERS if near(a, b)), "Custom")
    yield (sum(1 for _ in body.iter(W + "p")), sum(1 for _ in body.iter(W + "tbl")), sum(1 for _ in images(content)), marked,
           max(1, sum(1 for _ in body.iter(W + "sectPr"))), orientation, size)


def table_cells(content: bytes | Package, wanted: Callable[[str, object], bool] = everything) -> Iterator[tuple]:
    """Trimmed cells of the body's wanted tables; a cell's paragraphs are joined by line ends."""
    for t, table in enumerate(_body(content).findall(W + "tbl")):
        if not wanted("table_idx", t):
            continue
        for i, row in enumerate(table.findall(W + "tr")):
            if not wanted("row", i):
                continue
            for k, cell in enumerate(row.findall(W + "tc")):
                yield t, i, k, "\n".join(_text(p) for p in cell.findall(W + "p")).strip()


def styles(content: bytes | Package) -> Iterator[tuple]:
    """Styles with a content; a missing name is the id, a missing type `paragraph`."""
    package = Package.of(content)
    if not package.has(STYLES):
        return
    for s in package.xml(STYLES).findall(W + "style"):
        if len(s):
            id_, name = s.get(W + "styleId", ""), s.find(W + "name")
            named = None if name is None else name.get(W + "val")
            yield id_, named or id_, s.get(W + "type", "paragraph"), s.get(W + "default") in ("1", "true")


def read_paragraphs(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, paragraphs, PARAGRAPHS, "*.docx", mode=mode)


def read_runs(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, runs, RUNS, "*.docx", mode=mode)


def read_table_cells(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, table_cells, TABLE_CELLS, "*.docx", mode=mode)


def read_styles(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, styles, STYLE_ROWS, "*.docx", mode=mode)


def read_images(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, images, IMAGES, "*.docx", mode=mode)


def read_relations(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, relations, RELATION_ROWS, "*.docx", mode=mode)


def read_media(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, media, "name string, content binary", "*.docx", mode=mode)


def read_summary(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, summary, SUMMARY, "*.docx", mode=mode)
