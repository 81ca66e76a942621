"""Markdown files as blocks: headings, paragraphs, list items, code and table rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from foliomill.sources.containers import scan

BLOCKS = "ord int, kind string, level int, text string"
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
ITEM = re.compile(r"([ \t]*)(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(.*)")
RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
#: Marks whose text alone stays: images and links, code, strong, emphasis.
INLINE = [(re.compile(p), r"\1") for p in (r"!?\[([^\]]*)\]\([^)]*\)", r"`([^`]+)`", r"\*\*(.+?)\*\*", r"__(.+?)__", r"\*([^*\s][^*]*)\*")]


def plain(text: str) -> str:
    for pattern, kept in INLINE:
        text = pattern.sub(kept, text)
    return text.strip()


def blocks(content: bytes) -> Iterator[tuple]:
    """Blocks in order; `level` is set for headings (1 to 6), rows of a table have cells joined by tabs."""
    out: list[tuple[str, int | None, str]] = []
    held: list[str] = []
    code: list[str] | None = None
    fence = ""

    def end_paragraph() -> None:
        if held:
            out.append(("paragraph", None, plain(" ".join(x.strip() for x in held))))
            held.clear()

    for line in content.decode("utf-8-sig", "replace").splitlines():
        if code is not None:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                out.append(("code", None, "\n".join(code)))
                code = None
            else:
                code.append(line)
        elif at := FENCE.match(line):
            end_paragraph()
            code, fence = [], at[1]
        elif not line.strip():
            end_paragraph()
        elif at := HEADING.fullmatch(line):
            end_paragraph()
            out.append(("heading", len(at[1]), plain(at[2] or "")))
        elif line.strip().startswith("|"):
            end_paragraph()
            if not RULE.fullmatch(line):
                out.append(("table_row", None, "\t".join(plain(c) for c in line.strip().strip("|").split("|"))))
        elif at := ITEM.fullmatch(line):
            end_paragraph()
            out.append(("item", None, plain(at[2])))
        else:
            held.append(line)
    end_paragraph()
    if code is not None:  # a fence that isn't closed reaches to the end
        out.append(("code", None, "\n".join(code)))
    return ((i, *b) for i, b in enumerate(out))


def read_blocks(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return scan(spark, path, blocks, BLOCKS, "*.md", mode=mode)
