"""Operators over cells (doc_id, sheet, row, col, value) and rows (sheet, row, vals)."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.documents import with_error


def letters_number(letters: str) -> int:
    """A -> 1, Z -> 26, AA -> 27."""
    return functools.reduce(lambda n, c: n * 26 + ord(c) - 64, letters.upper(), 0)


def parse_range(text: str) -> tuple[int, int, int, int]:
    """`A1:D10` -> zero-based first row, first column, last row, last column."""
    corners = re.findall(r"([A-Za-z]+)(\d+)", text)
    if not re.fullmatch(r"[A-Za-z]+\d+(:[A-Za-z]+\d+)?", text):
        raise ValueError(f"not a range: {text!r}")
    cols, rows = ([max(0, f(c[i]) - 1) for c in corners] for i, f in ((0, letters_number), (1, int)))
    return min(rows), min(cols), max(rows), max(cols)


def inspect(rows: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Sheet sizes and the range they span; with a list of sheets (sheet), those without rows are 0 by 0."""
    sizes = rows.groupBy("sheet").agg((F.max("row") + 1).alias("n_rows"), F.max(F.size("vals")).alias("n_cols"))
    if sheets is not None:
        none = F.lit(0).cast("int")
        sizes = sheets.select("sheet").join(sizes, "sheet", "left").select("sheet", F.coalesce("n_rows", none).alias("n_rows"), F.coalesce("n_cols", none).alias("n_cols"))
    end = F.when((F.col("n_rows") == 0) | (F.col("n_cols") == 0), "A1").otherwise(F.concat(T.column_letters(F.col("n_cols")), F.col("n_rows").cast("string")))
    return sizes.withColumn("range", F.concat(F.lit("A1:"), end))


def search(rows: DataFrame, keyword: str, limit: int = 0, sheet: str | None = None) -> DataFrame:
    """One row for each cell that holds `keyword` (case matters), with its whole row; 1-based places.

    The limit goes by sheet, row and column; sheets by `sheet_ord` where there is one, else by
    name.  An empty keyword is in every cell; a sheet that is named and missing is an error.
    """
    if sheet is not None:
        there = rows.agg(F.max(F.when(F.col("sheet") == sheet, 1)).alias("_there"))
        rows = rows.where(F.col("sheet") == sheet)
    order = ["sheet_ord"] if "sheet_ord" in rows.columns else ["sheet"]
    hits = rows.select("sheet", *order[: order[0] == "sheet_ord"], "row", F.posexplode("vals").alias("col", "matched_value"), F.col("vals").alias("row_data")).where(F.col("matched_value").contains(keyword))
    hits = hits.withColumn("row", F.col("row") + 1).withColumn("col", F.col("col") + 1)
    out = (hits.orderBy(*order, "row", "col").limit(limit) if limit else hits).select("sheet", "row", "col", "matched_value", "row_data")
    return out if sheet is None else with_error(out, there, F.col("_there").isNull(), F.lit(f"no sheet {sheet!r}"))


def read_range(rows: DataFrame, cell_range: str, head: int | None = None) -> DataFrame:
    """Rows and columns of an inclusive range, then the first `head` rows."""
    r1, c1, r2, c2 = parse_range(cell_range)
    out = rows.where(F.col("row").between(r1, r2)).select("sheet", "row", F.slice("vals", c1 + 1, c2 - c1 + 1).alias("vals"))
    return out.orderBy("sheet", "row").limit(head) if head else out


def style_range(styles: DataFrame, cell_range: str, sheet: str, group: str = "path") -> DataFrame:
    """Formats (group, sheet, row, col, ...) of every place of a range, with `coord` like `B2` and `status`: formatted, or empty_or_default where a workbook has none."""
    r1, c1, r2, c2 = parse_range(cell_range)
    rest = [c for c in styles.columns if c not in (group, "sheet", "row", "col")]
    books = styles.select(group).distinct().select(group, F.explode(F.sequence(F.lit(r1), F.lit(r2))).alias("row")).select(group, "row", F.explode(F.sequence(F.lit(c1), F.lit(c2))).alias("col"))
    there = styles.where((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2)).select(
        F.col(group).alias("_g"), F.col("row").alias("_r"), F.col("col").alias("_c"), *rest, F.lit("formatted").alias("_status"))
    filled = books.join(there, (F.col(group) == F.col("_g")) & (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left")
    coord = F.concat(T.column_letters(F.col("col") + 1), (F.col("row") + 1).cast("string"))
    return filled.select(group, "row", "col", coord.alias("coord"), F.coalesce("_status", F.lit("empty_or_default")).alias("status"), *rest)


def upsert_cell(cells: DataFrame, place: str, value: str, sheet: str) -> DataFrame:
    """Cells (sheet, row, col, value) with `kind`, the one at a place like `B2` written or added; its kind is inferred."""
    row, col, _, _ = parse_range(place)
    there = (F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col)
    kept = cells if "kind" in cells.columns else cells.withColumn("kind", F.lit(None).cast("string"))
    new = kept.sparkSession.createDataFrame([(sheet, row, col, value)], "sheet string, row int, col int, value string")
    new = new.withColumn("kind", T.infer_kind(F.col("value")))
    return kept.where(~there).select("sheet", "row", "col", "value", "kind").unionByName(new)


def append_values(cells: DataFrame, values: list[str], sheet: str) -> DataFrame:
    """Cells (sheet, row, col, value) with `kind` and a row of values after the sheet's last, or as its first; kinds are inferred."""
    kept = cells if "kind" in cells.columns else cells.withColumn("kind", F.lit(None).cast("string"))
    last = kept.where(F.col("sheet") == sheet).agg(F.coalesce(F.max("row") + 1, F.lit(0)).cast("int").alias("row"))
    new = last.select(F.lit(sheet).alias("sheet"), "row", F.posexplode(F.array(*map(F.lit, values)).cast("array<string>")).alias("col", "value"))
    return kept.select("sheet", "row", "col", "value", "kind").unionByName(new.withColumn("kind", T.infer_kind(F.col("value"))))


def manage_sheet(sheets: DataFrame, action: str, sheet: str, new_name: str | None = None) -> DataFrame:
    """The list of sheets (sheet_ord, sheet) after `add`, `remove` or `rename`.

    Adding one that is there changes nothing; the last sheet can't be removed; renaming needs a
    new name.
    """
    if action == "add":
        end = sheets.agg((F.coalesce(F.max("sheet_ord"), F.lit(-1)) + 1).cast("int").alias("sheet_ord"), F.max(F.when(F.col("sheet") == sheet, 1)).alias("_there"))
        return sheets.select("sheet_ord", "sheet").unionByName(end.where("_there is null").select("sheet_ord", F.lit(sheet).alias("sheet")))
    if action == "rename":
        if not new_name:
            raise ValueError("renaming needs a new name")
        return sheets.withColumn("sheet", F.when(F.col("sheet") == sheet, F.lit(new_name)).otherwise(F.col("sheet")))
    if action != "remove":
        raise ValueError(f"not an action: {action!r}")
    if sheets.count() <= 1:
        raise ValueError("the last sheet stays")
    order = Window.orderBy("sheet_ord")
    return sheets.where(F.col("sheet") != sheet).withColumn("sheet_ord", F.row_number().over(order) - 1)  # a row a sheet


def autofit_columns(cells: DataFrame, least: float = 10, most: float = 60) -> DataFrame:
    """Width of each column: its widest line plus 3, between least and most."""
    lines = cells.select("sheet", "col", F.explode(F.split("value", "\n")).alias("line"))
    widest = lines.groupBy("sheet", "col").agg(F.max(T.visual_width(F.col("line"))).alias("w"))
    width = F.when(F.col("w") == 0, F.lit(float(least))).otherwise(F.least(F.greatest(F.col("w") + 3, F.lit(float(least))), F.lit(float(most))))
    return widest.select("sheet", "col", F.round(width, 4).alias("width"))


def autofit_rows(cells: DataFrame) -> DataFrame:
    """Height of each row: 18, and 14 for each line after the first of its tallest cell."""
    return cells.groupBy("sheet", "row").agg((18.0 + 14.0 * (F.max(F.size(F.split("value", "\n"))) - 1)).alias("height"))


def insert_lines(cells: DataFrame, axis: str, at: int, count: int = 1) -> DataFrame:
    return cells.withColumn(axis, F.col(axis) + F.when(F.col(axis) >= at, count).otherwise(0))


def delete_lines(cells: DataFrame, axis: str, at: int, count: int = 1) -> DataFrame:
    kept = cells.where(~F.col(axis).between(at, at + count - 1))
    return kept.withColumn(axis, F.col(axis) - F.when(F.col(axis) >= at + count, count).otherwise(0))
