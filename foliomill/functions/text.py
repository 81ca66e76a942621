"""Scalar functions of the document operators, as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(c: Column) -> Column:
    """Trim all Unicode white space (F.trim only knows the blank)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return utrim(c) == ""


def nonspace_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def visual_width(c: Column) -> Column:
    """Line breaks 0, ASCII (up to 127) 1.1, others 2.1."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    narrow = F.length(F.regexp_replace(c, r"[^\x00-\x7F]|[\r\n]", ""))
    return narrow * F.lit(1.1) + wide * F.lit(2.1)


def line_width(c: Column, narrow: float, wide: float) -> Column:
    """Width of a line with fixed advances for ASCII and other characters."""
    n_wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return (F.length(c) - n_wide) * F.lit(narrow) + n_wide * F.lit(wide)


def column_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA (bijective base 26), up to 8 letters."""
    digit = lambda x: F.char(65 + F.pmod(x - 1, F.lit(26)))
    rest = lambda x: F.floor((x - 1) / 26).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), F.struct(F.lit("").alias("s"), n.cast("long").alias("n")),
        lambda acc, _: F.struct(
            F.when(acc["n"] > 0, F.concat(digit(acc["n"]), acc["s"])).otherwise(acc["s"]).alias("s"),
            F.when(acc["n"] > 0, rest(acc["n"])).otherwise(F.lit(0).cast("long")).alias("n")),
        lambda acc: acc["s"])


def column_number(letters: Column) -> Column:
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def infer_kind(c: Column) -> Column:
    """Kind of a written cell: formula, number, bool or string.  Nothing is trimmed."""
    number = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
    return F.when(F.startswith(c, F.lit("=")), "formula").when(c.rlike(number), "number").when(c.isin("true", "false"), "bool").otherwise("string")


def argb(c: Column) -> Column:
    bare = F.upper(F.regexp_replace(c, "^#+", ""))
    return F.when(F.length(bare) == 6, F.concat(F.lit("FF"), bare)).otherwise(bare)


def normalise_for_match(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def likely_heading(c: Column, dotted: bool = False) -> Column:
    """Short (60 bytes) and either a numbered chapter in Chinese or a number first, of digits and points.

    A point anywhere in the line makes it a heading, as in the tools; with `dotted` the number itself must have one.
    """
    t = utrim(c)
    number = t.rlike(r"(?U)^[0-9][0-9.]*\.[0-9.]*(\s|$)") if dotted else t.rlike(r"^[0-9]") & F.contains(t, F.lit(".")) & t.rlike(r"(?U)^[0-9.]+(\s|$)")
    return (F.octet_length(t) <= 60) & (t.rlike("^第.*[章节篇]") | number)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliding_chunks(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Array of overlapping pieces; a text no longer than `size` is one piece, even if empty."""
    size = size or 500
    overlap = size // 5 if overlap >= size else overlap
    step = max(1, size - overlap)

    def cut(t: Column) -> Column:
        k = F.when(F.length(t) <= size, F.lit(0)).otherwise(F.ceil((F.length(t) - size) / step).cast("int"))
        pieces = F.transform(F.sequence(F.lit(0), k), lambda i: utrim(F.substring(t, i * step + 1, F.lit(size))))
        return F.when(F.length(t) <= size, F.array(t)).otherwise(F.filter(pieces, lambda p: p != ""))

    return let(text, cut)


def token_estimate(n_chars: Column) -> Column:
    return F.round(n_chars * F.lit(0.75)).cast("bigint")


def block_width(c: Column, font_size: Column) -> Column:
    """Width of a text in a font: 0.55 of its size for ASCII, the whole size for others."""
    n_wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return (F.length(c) - n_wide) * (font_size * F.lit(0.55)) + n_wide * font_size


def rounded(c: Column, digits: int = 1) -> Column:
    """Half away from zero, by scaling as the tools do it."""
    return F.round(c * F.lit(float(10**digits))) / F.lit(float(10**digits))


def emu_mm(c: Column) -> Column:
    """English metric units as millimetres; null unless positive."""
    mm = rounded(c / F.lit(36000.0))
    return F.when(mm > 0, mm)


def paper_twips(w: Column, h: Column) -> Column:
    hi, lo = F.greatest(w, h), F.least(w, h)
    near = lambda a, b: (F.abs(hi - a) < 100) & (F.abs(lo - b) < 100)
    return F.when(near(16838, 11906), "A4").when(near(23811, 16838), "A3").when(near(15840, 12240), "Letter").otherwise("Custom")


def is_heading_style(style: Column, titles: bool = False) -> Column:
    """Whether a style's name is a heading's; with `titles`, a title's too."""
    low = F.lower(F.coalesce(style, F.lit("")))
    out = F.contains(low, F.lit("heading")) | F.contains(low, F.lit("标题"))
    return out | F.contains(low, F.lit("title")) if titles else out


def image_type(content: Column, content_type: Column | None = None) -> Column:
    """jpg, png, webp, gif or bmp by the first bytes, else by the content type, else jpg."""
    head, kind = F.hex(F.substring(content, 1, 12)), F.lower(F.coalesce(content_type if content_type is not None else F.lit(None).cast("string"), F.lit("")))
    out = (F.when(F.startswith(head, F.lit("FFD8FF")), "jpg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
           .when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^474946383[79]61"), "gif").when(F.startswith(head, F.lit("424D")), "bmp"))
    for name, as_ in (("jpeg", "jpg"), ("jpg", "jpg"), ("png", "png"), ("webp", "webp"), ("gif", "gif")):
        out = out.when(F.contains(kind, F.lit(name)), as_)
    return out.otherwise("jpg")


def clean_path(c: Column) -> Column:
    """Blanks at the ends, then double quotes, then single quotes go; an escaped double quote is unescaped."""
    bare = F.regexp_replace(F.regexp_replace(utrim(c), '^"+|"+$', ""), "^'+|'+$", "")
    return F.replace(bare, F.lit('\\"'), F.lit('"'))


def _number(c: Column) -> Column:
    """A whole number without a minus sign, else null."""
    return F.when(c.rlike(r"\A\+?[0-9]+\z"), c.try_cast("long"))


def _sides(spec: Column) -> tuple[Column, Column]:
    return _number(F.regexp_extract(spec, r"(?s)\A([^:]*):", 1)), _number(F.regexp_extract(spec, r"(?s)\A[^:]*:(.*)\z", 1))


def page_span(spec: Column, total: Column, strict: bool = False) -> Column:
    """(first, last) of the pages that `all`, `7` or `a:b` names; null where the named pages don't exist.

    A side that is no number is the first or the last page.  A null or anything else is all pages, or
    null if `strict`.
    """
    first, last = _sides(spec)
    first, last = F.greatest(F.lit(1), F.coalesce(first, F.lit(1))), F.least(total, F.coalesce(last, total))
    one, span = _number(spec), lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    everything = span(F.lit(1), total)
    out = (F.when(F.lower(spec) == "all", everything).when(F.contains(spec, F.lit(":")), F.when(first <= last, span(first, last)))
           .when(one.isNotNull(), F.when((one >= 1) & (one <= total), span(one, one))))
    return out if strict else out.otherwise(everything)


def paragraph_span(spec: Column, count: Column) -> Column:
    """(first, last), from 0, of `a:b` or one number; a side that is no number is the first or the last paragraph; null for anything else."""
    first, last = _sides(spec)
    first, last = F.coalesce(first, F.lit(0)), F.coalesce(last, F.greatest(F.lit(0), count - 1))
    one, span = _number(spec), lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    return F.when(F.contains(spec, F.lit(":")), span(first, last)).when(one.isNotNull(), span(one, one))


def key_values(c: Column) -> Column:
    """`a=b,c=d` as a map: pairs without `=` are left out, both sides are trimmed, the last of equal keys stays."""
    pairs = F.filter(F.transform(F.split(c, ","), lambda p: F.struct(utrim(F.regexp_extract(p, r"(?s)^([^=]*)=", 1)).alias("k"), utrim(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
                                                                      F.contains(p, F.lit("=")).alias("ok"))), lambda e: e["ok"])
    in_order = F.array_sort(F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), (-i).alias("i"), e["v"].alias("v"))))  # the last of equal keys first
    return let(in_order, lambda all_: F.map_from_entries(F.transform(
        F.filter(all_, lambda e, i: (i == 0) | ~F.get(all_, i - 1)["k"].eqNullSafe(e["k"])), lambda e: F.struct(e["k"], e["v"]))))


def breadcrumb(parent: Column, title: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", title).otherwise(F.concat(parent, F.lit(" / "), title))


def lines_as_markdown(text: Column, dotted: bool = False) -> Column:
    """Lines trimmed, likely headings as `###` between empty lines."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return F.array_join(F.transform(lines, lambda line: F.when(likely_heading(line, dotted), F.concat(F.lit("\n### "), utrim(line), F.lit("\n"))).otherwise(utrim(line))), "\n")


def matches_title(title: Column, query: str) -> Column:
    """Either holds the other, without marks and case, or as they stand without case; an empty side fits nothing."""
    q, t = F.lit(query), F.coalesce(title, F.lit(""))
    both = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return both(normalise_for_match(t), normalise_for_match(q)) | both(F.lower(t), F.lower(utrim(q)))


def paper(w: Column, h: Column) -> Column:
    hi, lo = F.greatest(w, h), F.least(w, h)
    near = lambda a, b: (F.abs(hi - a) < 10) & (F.abs(lo - b) < 10)
    return F.when(near(841.89, 595.28), "A4").when(near(1190.55, 841.89), "A3").when(near(792, 612), "Letter").otherwise("Custom")


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").otherwise("portrait")


def rotated(current: Column, angle: int) -> Column:
    if angle % 90:
        raise ValueError("angles are multiples of 90")
    return F.pmod(current + F.lit(angle), F.lit(360))


def heading_level(style: Column) -> Column:
    """Level 1 to 6 of a style name; the first digit that fits wins."""
    low, out = F.lower(style), F.lit(None).cast("int")
    for n in range(6, 0, -1):
        hit = F.contains(low, F.lit(f"heading{n}")) | F.contains(low, F.lit(f"heading {n}")) | (F.contains(style, F.lit("标题")) & F.contains(style, F.lit(str(n))))
        out = F.when(hit, n).otherwise(out)
    return out


def csv_line(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))
    return F.concat(F.array_join(quoted, ","), F.lit("\n"))


def markdown_line(values: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |\n"))


def markdown_table(rows: Column) -> Column:
    """An array of rows as a Markdown table; the first row is its header.  Bars in cells stay as they are."""
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit(" --- |")), ""), F.lit("\n"))
    lines = F.transform(rows, lambda r, i: F.concat(markdown_line(r), F.when(i == 0, rule).otherwise("")))
    return F.array_join(lines, "")


def csv_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, csv_line), "")


def find_date(c: Column) -> Column:
    """The first four digits with a separator after them that give eight bytes at least; no calendar check.

    Eleven characters are taken at most, blanks at the ends go, then brackets.
    """
    found = F.regexp_extract_all(c, F.lit(r"(?s)(?=([0-9]{4}[-/.年].{3,6}))"), 1)
    clean = F.transform(found, lambda d: F.regexp_replace(utrim(d), r"^[\[\]()]+|[\[\]()]+$", ""))
    return F.get(F.filter(clean, lambda d: F.octet_length(d) >= 8), F.lit(0))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
