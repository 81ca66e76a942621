"""Spreadsheet containers as cells with absolute positions (row and column from 0)."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from foliomill.operators.sheets import letters_number
from foliomill.sources.containers import Package, everything, scan

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELLS = "sheet_ord int, sheet string, row int, col int, kind string, value string"
POSITION = re.compile(r"([A-Z]+)([0-9]+)")


def _strings(package: Package) -> list[str]:
    if not package.has("xl/sharedStrings.xml"):
        return []
    return [_joined(i) for i in package.xml("xl/sharedStrings.xml").findall(S + "si")]


def _joined(item: ElementTree.Element) -> str:
    """The text of a string item and of its rich runs; phonetic guides are left out."""
    return "".join(t.text or "" for t in [*item.findall(S + "t"), *item.findall(f"{S}r/{S}t")])


def _value(cell: ElementTree.Element, shared: list[str], dates: list[bool]) -> tuple[str, str] | None:
    """(kind, value) of a cell; None for a cell without one.

    Texts are trimmed; a number whose format shows a date is its serial with four decimals.
    """
    kind, raw = cell.get("t", "n"), cell.findtext(S + "v")
    if kind == "inlineStr":
        inline = cell.find(S + "is")
        return ("string", "" if inline is None else _joined(inline).strip())
    if raw is None:
        return None
    if kind == "s":
        return "string", shared[int(raw)].strip()
    if kind == "b":
        return "bool", "true" if raw.strip() in ("1", "true") else "false"
    if kind == "e":
        return "error", raw
    if kind == "d":
        return "date_iso", raw
    if kind == "n":
        number, style = float(raw), int(cell.get("s", "0"))
        if style < len(dates) and dates[style]:
            return "date", f"{number:.4f}"
        return ("int", str(int(number))) if number.is_integer() and abs(number) < 2**53 else ("float", repr(number))
    return "string", raw.strip()


def _sheet_parts(package: Package, wanted: Callable[[str, object], bool]) -> Iterator[tuple[int, str, str]]:
    """(sheet_ord, sheet, part) of the wanted sheets, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target", "") for r in package.xml("xl/_rels/workbook.xml.rels").findall(P + "Relationship")}
    for i, sheet in enumerate(package.xml("xl/workbook.xml").iter(S + "sheet")):
        if wanted("sheet_ord", i) and wanted("sheet", sheet.get("name")):
            yield i, sheet.get("name"), posixpath.normpath(posixpath.join("xl", targets[sheet.get(R + "id")])).lstrip("/")


def cells(content: bytes, wanted: Callable[[str, object], bool] = everything) -> Iterator[tuple]:
    """Every cell with a value of the wanted sheets and rows; a formula gives its stored result.

    A sheet that isn't wanted is not inflated, and the shared strings aren't where no sheet is.
    """
    package = Package.of(content)
    shared = dates = None
    for ord_, sheet, name in _sheet_parts(package, wanted):
        if shared is None:
            shared, dates = _strings(package), date_formats(package)
        row = -1
        for line in package.xml(name).iter(S + "row"):
            row, col = int(line.get("r", row + 2)) - 1, -1
            if not wanted("row", row):
                continue
            for cell in line.findall(S + "c"):
                at = POSITION.fullmatch(cell.get("r", ""))
                col = letters_number(at[1]) - 1 if at else col + 1
                if (found := _value(cell, shared, dates)) is not None:
                    yield ord_, sheet, row, col, *found


def sheets(content: bytes) -> Iterator[tuple]:
    """(sheet_ord, sheet) of all sheets, those without cells too."""
    for i, sheet in enumerate(Package.of(content).xml("xl/workbook.xml").iter(S + "sheet")):
        yield i, sheet.get("name")


#: Numbers of the built-in formats that show dates and times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def is_date_code(code: str) -> bool:
    """Does a number format's code show a date or time?  Quoted and escaped text and what stands in brackets says nothing, but for hours, minutes and seconds that run on."""
    first = code.split(";")[0]
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", first)
    if re.search(r"\[(h+|m+|s+)\]", bare, re.I):
        return True
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and not re.fullmatch(r"general", bare.strip(), re.I)


def date_formats(package: Package) -> list[bool]:
    """For each cell format: is a number in it a date?"""
    if not package.has("xl/styles.xml"):
        return []
    book = package.xml("xl/styles.xml")
    codes = {int(f.get("numFmtId", "-1")): f.get("formatCode", "") for f in book.findall(f"{S}numFmts/{S}numFmt")}
    shows = lambda i: is_date_code(codes[i]) if i in codes else i in DATE_FORMATS
    return [shows(int(xf.get("numFmtId", "0"))) for xf in book.findall(f"{S}cellXfs/{S}xf")]


def cell_styles(content: bytes, wanted: Callable[[str, object], bool] = everything) -> Iterator[tuple]:
    """The font, colours, alignment and border of every cell that names a format; a missing size is 11, missing alignments are general and bottom."""
    package = Package.of(content)
    if not package.has("xl/styles.xml"):
        return
    book = package.xml("xl/styles.xml")
    part = lambda name: book.findall(f"{S}{name}/*")
    fonts, fills, borders, formats = part("fonts"), part("fills"), part("borders"), book.findall(f"{S}cellXfs/{S}xf")
    for ord_, sheet, name in _sheet_parts(package, wanted):
        for cell in package.xml(name).iter(S + "c"):
            at, style = POSITION.fullmatch(cell.get("r", "")), int(cell.get("s", "0"))
            if not at or "s" not in cell.attrib or style >= len(formats) or not wanted("row", int(at[2]) - 1):
                continue
            xf = formats[style]
            pick = lambda kind, all_: next(iter(all_[int(xf.get(kind, "0")) :]), None)
            font, fill, border, align = pick("fontId", fonts), pick("fillId", fills), pick("borderId", borders), xf.find(S + "alignment")
            of = lambda node, tag, key="val": None if node is None or node.find(tag) is None else node.find(tag).get(key)
            bold = font is not None and font.find(S + "b") is not None and font.find(S + "b").get("val", "1") in ("1", "true")
            yield (ord_, sheet, int(at[2]) - 1, letters_number(at[1]) - 1, bold, float(of(font, S + "sz") or 11.0), of(font, S + "name"), of(font, S + "color", "rgb"),
                   of(fill, f"{S}patternFill/{S}fgColor", "rgb"), "general" if align is None else align.get("horizontal", "general"),
                   "bottom" if align is None else align.get("vertical", "bottom"), border is not None and any(side.get("style") for side in border))


STYLES = "sheet_ord int, sheet string, row int, col int, bold boolean, size double, font string, color string, fill string, horizontal string, vertical string, border boolean"


def read_sheets(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, sheets, "sheet_ord int, sheet string", "*.xlsx", mode=mode)


def read_cell_styles(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, cell_styles, STYLES, "*.xlsx", mode=mode)


def read_cells(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, cells, CELLS, "*.xlsx", mode=mode)
