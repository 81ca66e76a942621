"""Summaries, styles, media, and ranges of pages as relations: nulls, empty tables, ties, odd ranges."""

import pytest
from pyspark.sql import functions as F

from foliomill.functions import ranges
from foliomill.functions import text as T
from foliomill.operators import documents as D

SPECS = ["2", "2:3", ":2", "x", "All", "3:", "9:2", "+1", "a:b", "0", "-1:2", "", ":", "1:2:3", "4:4", " 2", "2\n", "99999999999999999999", "5"]


def span(read, total, spec):
    try:
        found = read(total, pages=spec)
    except ValueError:
        return None
    return (found[0], found[-1]) if len(found) else None


@pytest.mark.parametrize("total", [1, 4])
def test_spans_equal_the_parsers_of_arguments(spark, total):
    rows = spark.createDataFrame([(s,) for s in SPECS], "spec string")
    got = {r.spec: r for r in rows.select("spec", T.page_span(F.col("spec"), F.lit(total)).alias("text"), T.page_span(F.col("spec"), F.lit(total), True).alias("strict"),
                                          T.paragraph_span(F.col("spec"), F.lit(total)).alias("para")).collect()}
    for s in SPECS:
        if s.startswith("9999"):  # no 64-bit number, so no number
            continue
        assert (got[s].text and tuple(got[s].text)) == span(ranges.text_pages, total, s), s
        assert (got[s].strict and tuple(got[s].strict)) == span(ranges.edited_pages, total, s), s
        try:
            para = ranges.paragraph_span(s, total)
        except ValueError:
            para = None
        assert (got[s].para and tuple(got[s].para)) == para, s


def test_selected_pages(spark):
    pages = spark.createDataFrame([(d, p, None if p == 2 else f"{d}.{p}") for d in (1, 2, 3, 4) for p in (1, 2, 3)], "doc_id long, page int, text string")
    wanted = spark.createDataFrame([(1, "2:"), (2, "7"), (3, None), (9, "1"), (None, "1")], "doc_id long, spec string")
    got = sorted(map(tuple, D.select_pages(pages, wanted).collect()), key=repr)
    assert got == sorted([(1, 2, None, None), (1, 3, "1.3", None), (2, None, None, "not a range of pages: 7"), (3, 1, "3.1", None), (3, 2, None, None), (3, 3, "3.3", None)], key=repr)
    assert [r.error for r in D.select_pages(pages, wanted.where("doc_id = 3"), strict=True).collect()] == ["not a range of pages: null"]
    assert D.select_pages(pages.limit(0), wanted).count() == 0 and D.select_pages(pages, wanted.limit(0)).count() == 0


def test_summaries(spark):
    paras = spark.createDataFrame([(1, "a"), (1, ""), (2, "b"), (3, None)], "doc_id long, text string")
    cells = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (5, 0)], "doc_id long, table_idx int")
    images = spark.createDataFrame([(2,)], "doc_id long")
    runs = spark.createDataFrame([(1, "x", "none"), (1, " ", "red"), (1, "y", None), (1, None, "red")], "doc_id long, text string, highlight string")
    sections = spark.createDataFrame(
        [(1, 0, 16838, 11906, None), (1, 1, 11906, 16838, None), (2, 0, 15840, 12240, None), (2, 1, 11906, 16838, "portrait"), (3, 0, None, None, "landscape")],
        "doc_id long, sect_idx int, w int, h int, orient string")
    got = sorted(map(tuple, D.summaries(paras, cells, images, runs, sections).collect()))
    assert got == [(1, 2, 2, 0, 1, 2, "landscape", "A4"), (2, 1, 0, 1, 0, 2, "portrait", "A4"), (3, 1, 0, 0, 0, 1, "landscape", "Custom")]
    alone = D.summaries(paras, cells.limit(0), images.limit(0), runs.limit(0), sections.limit(0)).where("doc_id = 1").first()
    assert tuple(alone) == (1, 2, 0, 0, 0, 1, "portrait", "A4")
    assert D.summaries(paras.limit(0), cells, images, runs, sections).count() == 0


def test_styles_and_media(spark):
    styles = spark.createDataFrame([("a", "A", "table"), ("b", "", None), (None, None, None)], "style_id string, name string, type string")
    assert sorted(map(tuple, D.named_styles(styles).collect())) == [("", "", "paragraph"), ("a", "A", "table"), ("b", "b", "paragraph")]
    parts = spark.createDataFrame([("word/media/a.png",), ("word/media/x/b.png",), ("word/media/",), ("word/media/d/",), ("word/a.png",), ("xword/media/a",), (None,)], "name string")
    assert sorted(r.name for r in D.media_files(parts).collect()) == ["a.png", "b.png"]
