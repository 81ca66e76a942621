"""Layout inference over positioned text: (doc_id, page, elem_ord, x, y, text, font_size).

elem_ord is unique in a page and breaks all ties.  What needs the order of a page (lines about
their first element, columns about a running mean) is a fold over the page's sorted coordinates, one
number for each height or element, whose state is the lines or columns so far.  Pages without
elements give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

PAGE = ("doc_id", "page")


def noise_filter(elems: DataFrame, page_height: Column) -> DataFrame:
    """Drop short or numeric elements in the outer 5 % of the text's span, on pages with enough text."""
    w = Window.partitionBy(*PAGE)
    lo, hi, n = F.min("y").over(w), F.max("y").over(w), F.count(F.lit(1)).over(w)
    marked = elems.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_n", n)
    span = F.col("_hi") - F.col("_lo")
    outer = (F.col("y") >= F.col("_hi") - span * 0.05) | (F.col("y") <= F.col("_lo") + span * 0.05)
    t = T.utrim(F.col("text"))
    noise = outer & (t.rlike(r"^[0-9\-/ ]*$") | (F.length(t) < 10))
    return marked.where(~((page_height > 100) & (F.col("_n") > 15) & (span > 100) & noise)).drop("_lo", "_hi", "_n")


def _lines(elems: DataFrame, tolerance: float) -> DataFrame:
    """Elements with the number of their line: downwards, a line's first element is its anchor.

    The anchors of a page are a fold over its distinct heights; an element's line is the number of anchors that
    aren't below it.
    """
    rows = elems.select(*PAGE, "elem_ord", "x", F.col("y").cast("double").alias("y"), "text")
    near = lambda anchors, y: F.coalesce(F.abs(y - F.get(anchors, F.size(anchors) - 1)) <= tolerance, F.lit(False))
    heights = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_set("y"), asc=False).alias("_heights"))
    fold = F.aggregate("_heights", F.array().cast("array<double>"), lambda anchors, y: F.when(near(anchors, y), anchors).otherwise(F.concat(anchors, F.array(y))))
    anchors = heights.select(*PAGE, fold.alias("_anchors"))
    return rows.join(anchors, list(PAGE)).withColumn("line", F.size(F.filter("_anchors", lambda a: a >= F.col("y")))).drop("_anchors")


def _spaced(lines: DataFrame, gap: float, right: Column) -> DataFrame:
    """Elements with their piece of the line's text, a blank before it if it is more than `gap` off and both sides are ASCII letters or digits."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", F.desc("y"), "elem_ord")
    before = F.lag("text").over(w)
    blank = (F.col("x") - right > gap) & before.rlike("[A-Za-z0-9]$") & F.col("text").rlike("^[A-Za-z0-9]")
    return lines.withColumn("piece", F.concat(F.when(blank, " ").otherwise(""), F.col("text")))


def _joined() -> Column:
    """The pieces of a line by x, and what goes with its leftmost element."""
    return F.array_sort(F.collect_list(F.struct("x", (-F.col("y")).alias("d"), "elem_ord", "piece")))


def text_lines(elems: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """(doc_id, page, line, y, text): elements near a line's first element, joined by x; y is the leftmost one's.

    A blank goes between neighbours that are more than 2.5 apart and both end in ASCII letters or
    digits.  Lines without text are dropped; `line` numbers all lines.
    """
    w = Window.partitionBy(*PAGE, "line").orderBy("x", F.desc("y"), "elem_ord")
    spaced = _spaced(_lines(elems, tolerance), 2.5, F.lag(F.col("x") + T.line_width(F.col("text"), 6.5, 12.0)).over(w))
    whole = spaced.groupBy(*PAGE, "line").agg(_joined().alias("r"))
    text = T.utrim(F.array_join(F.transform("r", lambda r: r["piece"]), ""))
    return whole.select(*PAGE, "line", (-F.get("r", F.lit(0))["d"]).alias("y"), text.alias("text")).where(F.col("text") != "")


def bbox_lines(elems: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """(doc_id, page, line, text, x, y, width, height): lines with their boxes, of elements that aren't blank.

    A blank goes where an element is more than 3 off the rightmost end so far.
    """
    w = Window.partitionBy(*PAGE, "line").orderBy("x", F.desc("y"), "elem_ord").rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(elems.where(~T.blank(F.col("text"))), tolerance).withColumn("_right", F.col("x") + T.line_width(F.col("text"), 6.5, 12.0))
    spaced = _spaced(lines, 3.0, F.max("_right").over(w))
    whole = spaced.groupBy(*PAGE, "line").agg(_joined().alias("r"), F.max("_right").alias("right"))
    left = F.get("r", F.lit(0))
    text = T.utrim(F.array_join(F.transform("r", lambda r: r["piece"]), ""))
    return whole.select(*PAGE, "line", text.alias("text"), T.rounded(left["x"]).alias("x"), T.rounded(-left["d"]).alias("y"),
                        T.rounded(F.col("right") - left["x"]).alias("width"), F.lit(12.0).alias("height"))


def page_text(lines: DataFrame, gap: float = 18.0) -> DataFrame:
    """Lines of a page joined; a gap of more than `gap` makes a paragraph."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    joined = lines.withColumn("piece", F.concat(F.when(F.lag("y").over(w).isNull(), "").when(F.abs(F.lag("y").over(w) - F.col("y")) > gap, "\n\n").otherwise("\n"), F.col("text")))
    return joined.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda r: r["piece"]), "").alias("text"))


def blocks(elems: DataFrame) -> DataFrame:
    """Elements with text as blocks: trimmed, with `width` and `height` by their font, all rounded to 0.1."""
    text = T.utrim(F.col("text"))
    return elems.where(~T.blank(F.col("text"))).select(
        *PAGE, "elem_ord", T.rounded(F.col("x")).alias("x"), T.rounded(F.col("y")).alias("y"), T.rounded(T.block_width(text, F.col("font_size"))).alias("width"),
        T.rounded(F.col("font_size")).alias("height"), text.alias("text"))


def overlaps(boxes: DataFrame, most_dy: float = 2.0, ratio: float = 0.6) -> DataFrame:
    """Pairs of blocks of a page whose texts differ and that cover each other, with the box that both cover.

    The page and a band of y are equality keys, so no page is compared with all of itself.
    """
    band = F.floor(F.col("y") / most_dy)
    a = boxes.withColumn("band", band)
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns], F.explode(F.array(band - 1, band, band + 1)).alias("b_band"))
    near = a.join(b, (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page")) & (F.col("band") == F.col("b_band")))
    start = F.greatest("x", "b_x")
    shared = F.least(F.col("x") + F.col("width"), F.col("b_x") + F.col("b_width")) - start
    least = F.least("width", "b_width")
    fits = near.where((F.col("elem_ord") < F.col("b_elem_ord")) & (F.abs(F.col("y") - F.col("b_y")) < most_dy) & (shared > 0) & (least > 0)
                      & (shared / least > ratio) & (F.col("text") != F.col("b_text")))
    return fits.select(*PAGE, F.col("elem_ord").alias("a_ord"), F.col("b_elem_ord").alias("b_ord"), F.col("text").alias("text_a"), F.col("b_text").alias("text_b"),
                       F.round(shared / least, 4).alias("ratio"), start.alias("x"), "y", shared.alias("width"), F.greatest("height", "b_height").alias("height"))


def column_clusters(boxes: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """(doc_id, page, col_index, x_start, x_end): runs of sorted x near their running mean, two members at least."""

    entry = lambda mean, n: F.struct(mean.alias("mean"), n.alias("n"))

    def step(runs: Column, x: Column) -> Column:
        """The last run takes x if it is near its mean; else x opens a run."""
        last, head = F.get(runs, F.size(runs) - 1), F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        taken = F.concat(head, F.array(entry((last["mean"] * last["n"] + x) / (last["n"] + 1), last["n"] + 1)))
        return F.when(F.abs(x - last["mean"]) < tolerance, taken).otherwise(F.concat(runs, F.array(entry(x, F.lit(1)))))

    sorted_ = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("_x"))
    runs = sorted_.select(*PAGE, F.posexplode(F.aggregate("_x", F.array().cast("array<struct<mean:double,n:int>>"), step)).alias("run", "m"))
    last = runs.where(F.col("m.n") >= 2)
    w = Window.partitionBy(*PAGE).orderBy("run")
    columns = last.select(*PAGE, (F.row_number().over(w) - 1).alias("col_index"), T.rounded(F.col("m.mean")).alias("x_start"))
    following = F.lead("x_start").over(Window.partitionBy(*PAGE).orderBy("col_index"))
    return columns.withColumn("x_end", F.coalesce(following - 5, F.col("x_start") + 200))


def structured_rows(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, page, band, y, indent_level, cells): blocks by bands of 4 in y, each in the first column whose range has its x.

    A row has a cell for each column of its page, empty ones too; rows without text in any cell
    and pages without columns give nothing.  Rows go downwards as `band` falls.
    """
    per_page = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("col_index", "x_start", "x_end"))).alias("_columns"))
    b = boxes.join(per_page, list(PAGE)).withColumn("band", F.round(F.col("y") / 4).cast("long"))
    hit = F.filter("_columns", lambda c: (F.col("x") >= c["x_start"] - 10) & (F.col("x") < c["x_end"]))
    placed = b.withColumn("_col", F.get(hit, F.lit(0))["col_index"])
    rows = placed.groupBy(*PAGE, "band").agg(
        F.array_sort(F.collect_list(F.struct("x", "elem_ord", "y", "text", "_col"))).alias("_blocks"), F.first("_columns").alias("_columns"))
    first = F.get("_columns", F.lit(0))["x_start"]
    offset = F.get(F.filter("_blocks", lambda r: r["x"] < first + 100), F.lit(0))["x"] - first
    cells = F.transform("_columns", lambda c: F.array_join(F.transform(F.filter("_blocks", lambda r: r["_col"] == c["col_index"]), lambda r: r["text"]), " "))
    out = rows.select(*PAGE, "band", T.rounded(F.get("_blocks", F.lit(0))["y"]).alias("y"),
                      F.when(offset > 8, F.round(offset / 12).cast("int")).otherwise(0).alias("indent_level"), cells.alias("cells"))
    return out.where(F.exists("cells", lambda c: ~T.blank(c)))
