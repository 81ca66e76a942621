"""Page, paragraph and file arguments, parsed on the driver before anything is planned."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) else None


def _span(text: str, total: int) -> range:
    first, last = (_number(x) for x in text.split(":", 1))
    first, last = max(1, 1 if first is None else first), min(total, total if last is None else last)
    if first > last:
        raise ValueError(f"not a range of pages: {text!r}")
    return range(first, last + 1)


def _single(page: int, total: int) -> range:
    if not 1 <= page <= total:
        raise ValueError(f"page {page} of {total}")
    return range(page, page + 1)


def text_pages(total: int, page: int | None = None, pages: str | None = None) -> range:
    """Pages to read text from: one, `all`, `a:b` (a side that is no number is the first or last page); anything else is all."""
    if page is not None:
        return _single(page, total)
    if pages is not None and pages.lower() != "all":
        if ":" in pages:
            return _span(pages, total)
        if (n := _number(pages)) is not None:
            return _single(n, total)
    return range(1, total + 1)


def edited_pages(total: int, pages: str) -> range:
    """Pages to change: as for text, but what can't be parsed is an error."""
    if pages.lower() == "all" or ":" in pages or _number(pages) is not None:
        return text_pages(total, pages=pages)
    raise ValueError(f"not a range of pages: {pages!r}")


def paragraph_span(spec: str, count: int) -> tuple[int, int]:
    """Zero-based first and last paragraph of `a:b` or one number; a side that is no number is the first or last one."""
    if ":" in spec:
        first, last = (_number(x) for x in spec.split(":", 1))
        return 0 if first is None else first, max(0, count - 1) if last is None else last
    if (n := _number(spec)) is None:
        raise ValueError(f"not a range of paragraphs: {spec!r}")
    return n, n


def clean_path(path: str) -> str:
    return path.strip().strip('"').strip("'").replace('\\"', '"')


#: Kinds of image files.
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tiff")


def resolve_inputs(file: str | None = None, files: Iterable[str] = (), folder: str | None = None, listing: str | None = None,
                   endings: tuple[str, ...] = ("pdf",), exclude: str | None = None) -> list[str]:
    """Input files in order: one file, several, those of a folder by their ending, those of a list.

    The folder's step sorts all collected so far by file name; a list's files come after it in
    their order.  Lines of a list that are empty or begin with `#` are passed over.  Missing files
    and `exclude` are left out; a file named twice comes twice.  Nothing left is an error.
    """
    found = [clean_path(f) for f in ([file] if file else []) + list(files)]
    if folder is not None:
        place = clean_path(folder)
        if not os.path.isdir(place):
            raise FileNotFoundError(place)
        own = (e.path for e in os.scandir(place) if e.is_file())
        found += [p for p in own if os.path.splitext(p)[1][1:].lower() in endings]
        found.sort(key=lambda p: os.fsencode(os.path.basename(p)))
    if listing is not None:
        with open(clean_path(listing), encoding="utf-8") as lines:
            found += [clean_path(line) for line in lines if line.strip() and not line.strip().startswith("#")]
    out = None if exclude is None else os.path.realpath(clean_path(exclude))
    kept = [p for p in map(os.path.realpath, found) if os.path.exists(p) and p != out]
    if not kept:
        raise ValueError("no input files")
    return kept
