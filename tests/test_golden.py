"""Golden vectors: values worked out by hand from the rules of the operators."""

import pytest
from pyspark.sql import functions as F

from foliomill.functions import ranges
from foliomill.functions import text as T
from foliomill.operators import documents as D
from foliomill.operators import layout as L
from foliomill.operators import sheets as S
from foliomill.operators import web as W
from foliomill.sources import html as H


def each(spark, values, rule, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(rule(F.col("v"))).collect()]


def elems(spark, rows):
    return spark.createDataFrame([(1, 1, i, float(x), float(y), t, 11.0) for i, (x, y, t) in enumerate(rows)],
                                 "doc_id long, page int, elem_ord int, x double, y double, text string, font_size double")


def boxes(spark, rows):
    return spark.createDataFrame([(1, 1, i, float(x), float(y), float(w), 10.0, t) for i, (x, y, w, t) in enumerate(rows)],
                                 "doc_id long, page int, elem_ord int, x double, y double, width double, height double, text string")


def test_columns_and_ranges(spark):
    numbers = [1, 26, 27, 28, 52, 702, 703, 16384]
    letters = ["A", "Z", "AA", "AB", "AZ", "ZZ", "AAA", "XFD"]
    assert each(spark, numbers, T.column_letters, "long") == letters and each(spark, letters, T.column_number) == numbers
    assert [S.parse_range(x) for x in ("A1:D10", "d10:a1", "B2")] == [(0, 0, 9, 3), (0, 0, 9, 3), (1, 1, 1, 1)]
    for bad in ("A", "1", "A1:", "A1:B2:C3"):
        with pytest.raises(ValueError):
            S.parse_range(bad)


def test_cells(spark):
    assert each(spark, ["=A1", "007", "1e3", "NaN", "true", "True", " 12"], T.infer_kind) == ["formula", "number", "number", "number", "bool", "string", "string"]
    assert each(spark, ["#4f81bd", "FF4F81BD", "abc"], T.argb) == ["FF4F81BD", "FF4F81BD", "ABC"]
    assert [round(w, 6) for w in each(spark, ["ab", "中文", "abc中", ""], T.visual_width)] == [2.2, 4.2, 5.4, 0.0]
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))
    assert spark.range(1).select(T.markdown_table(rows)).first()[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert spark.range(1).select(T.csv_text(F.array(F.array(F.lit("a,b"), F.lit('c"d'), F.lit("e"))))).first()[0] == '"a,b","c""d",e\n'


def test_texts(spark):
    headings = ["第一章 概述", "1.2 Scope", "1.2a Scope", "2026 v1.0", "第十五", "12 items, 3.5 kg", "3. " + "x" * 60]
    # By the rule the first word holds digits and points only; a point anywhere counts.
    assert each(spark, headings, T.likely_heading) == [True, True, False, True, False, True, False]
    assert each(spark, [0, 1, 2, 3, 360, 500], T.token_estimate, "long") == [0, 1, 2, 2, 270, 375]
    cuts = lambda n, size, overlap: [len(c) for c in each(spark, ["x" * n], lambda v: T.sliding_chunks(v, size, overlap))[0]]
    assert [cuts(n, 500, 80) for n in (0, 500, 501, 1200)] == [[0], [500], [500, 81], [500, 500, 360]] and cuts(10, 4, 1) == [4, 4, 4]
    assert each(spark, ["Heading1", "heading 3", "标题2", "Heading10", "Title"], T.heading_level) == [1, 3, 2, 1, None]
    assert each(spark, ["Title", "x"], lambda c: T.is_heading_style(c, titles=True)) == [True, False] and each(spark, ["Title"], T.is_heading_style) == [False]
    dates = {"公告 [2026-03-09] 通知": "2026-03-09", "2026年03月09日": "2026年03月09日", "发布 2026/3/9 正文": "2026/3/9 正文", "2026-03": None, "v1234.5678 x": "1234.5678 x",
             "(2026.03.09)abc": "2026.03.09", "2026-03-09T10:00": "2026-03-09T", "1999-))))))2026-01-02": "2026-01-02"}
    assert each(spark, list(dates), T.find_date) == list(dates.values())
    assert each(spark, [' "a\\"b" ', "'x'", "p"], T.clean_path) == ['a"b', "x", "p"] == [ranges.clean_path(x) for x in (' "a\\"b" ', "'x'", "p")]
    assert each(spark, ["a=1, b = 2=3,c,a=4"], T.key_values) == [{"a": "4", "b": "2=3"}]
    assert each(spark, [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"RIFF1234WEBP", b"GIF89a", b"BMx", b"?"], T.image_type, "binary") == ["jpg", "png", "webp", "gif", "bmp", "jpg"]


def test_papers(spark):
    sizes = [(595.28, 841.89), (841.89, 595.28), (612.0, 792.0), (100.0, 100.0)]
    frame = spark.createDataFrame(sizes, "w double, h double")
    assert [tuple(r) for r in frame.select(T.orientation(F.col("w"), F.col("h")), T.paper(F.col("w"), F.col("h"))).collect()] == [
        ("portrait", "A4"), ("landscape", "A4"), ("portrait", "Letter"), ("portrait", "Custom")]
    assert each(spark, [3_600_000, 0], T.emu_mm, "long") == [100.0, None]
    assert [each(spark, [now], lambda c: T.rotated(c, turn), "int")[0] for now, turn in ((0, 90), (270, 180), (0, -90))] == [90, 90, 270]


def test_page_arguments(tmp_path):
    assert list(ranges.text_pages(5)) == list(ranges.text_pages(5, pages="ALL")) == list(ranges.text_pages(5, pages="odd")) == [1, 2, 3, 4, 5]
    assert list(ranges.text_pages(5, pages="x:2")) == [1, 2] and list(ranges.text_pages(5, pages="4:99")) == [4, 5] and list(ranges.text_pages(5, page=3)) == [3]
    for bad in ({"page": 0}, {"page": 6}, {"pages": "4:2"}, {"pages": "9"}):
        with pytest.raises(ValueError):
            ranges.text_pages(5, **bad)
    with pytest.raises(ValueError):
        ranges.edited_pages(5, "odd")
    assert ranges.paragraph_span("1:x", 5) == (1, 4) and ranges.paragraph_span("2", 5) == (2, 2)
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "list.txt").write_text(f"# no\n\n{tmp_path}/b.pdf\n{tmp_path}/missing.pdf\n")
    got = ranges.resolve_inputs(file=f'"{tmp_path}/c.txt"', folder=str(tmp_path), listing=f"{tmp_path}/list.txt", exclude=f"{tmp_path}/a.PDF")
    assert [p.rpartition("/")[2] for p in got] == ["b.pdf", "c.txt", "b.pdf"]
    with pytest.raises(ValueError):
        ranges.resolve_inputs(files=["/none"])


def test_lines(spark):
    whole = lambda rows: L.page_text(L.text_lines(elems(spark, rows))).first().text
    assert whole([(100, 700, "World"), (10, 700, "Hello"), (10, 686, "next"), (10, 650, "para")]) == "Hello World\nnext\n\npara"
    assert whole([(10, 700, "a"), (30, 695, "b"), (50, 690, "c")]) == "a b\nc"
    assert whole([(10, 700, " "), (10, 680, "x"), (30, 683, "中")]) == "x中"
    lines = {r.text: r.y for r in L.text_lines(elems(spark, [(30, 700, "b"), (10, 696, "a")])).collect()}
    assert lines == {"a b": 696.0}  # the leftmost element's place
    boxed = L.bbox_lines(elems(spark, [(10, 700, "ab"), (40, 698, "cd"), (5, 600, " ")])).collect()
    assert [(r.text, r.x, r.y, r.width, r.height) for r in boxed] == [("ab cd", 10.0, 700.0, 43.0, 12.0)]


def test_noise(spark):
    rows = [(10, 800, "3 / 9"), (10, 790, "a running head of the page"), (10, 100, "short")] + [(10, 700 - 20 * i, "body") for i in range(14)]
    kept = {r.text for r in L.noise_filter(elems(spark, rows), F.lit(842.0)).collect()}
    assert kept == {"a running head of the page", "body"}
    edge = [(10, 1000, "x" * 20), (10, 950, "cut")] + [(10, 900 - 20 * i, "body") for i in range(14)] + [(10, 0, "y" * 20)]
    assert "cut" not in {r.text for r in L.noise_filter(elems(spark, edge), F.lit(842.0)).collect()}  # the bound itself is outside
    assert L.noise_filter(elems(spark, rows[:5]), F.lit(842.0)).count() == 5


def test_overlaps(spark):
    found = lambda rows: [r.ratio for r in L.overlaps(boxes(spark, rows)).collect()]
    assert found([(10, 100, 50, "a"), (20, 101, 50, "b")]) == [0.8]
    assert found([(10, 100, 50, "a"), (20, 102, 50, "b")]) == found([(10, 100, 50, "a"), (20, 101, 50, "a")]) == []
    assert found([(0, 0, 100000, "a"), (39997, 0, 100000, "b")]) == [0.6] and found([(0, 0, 100, "a"), (40, 0, 100, "b")]) == []


def test_columns_of_a_page(spark):
    at = lambda xs: boxes(spark, [(x, 700 - 10 * i, 20, f"t{i}") for i, x in enumerate(xs)])
    columns = lambda b: [(r.x_start, r.x_end) for r in L.column_clusters(b).orderBy("col_index").collect()]
    assert columns(at([50, 50, 62, 200, 204, 350, 400, 400])) == [(54.0, 197.0), (202.0, 395.0), (400.0, 600.0)]
    assert columns(at([0, 10, 20, 30])) == [(10.0, 210.0)]
    b = boxes(spark, [(50, 700, 9, "a"), (50, 690, 9, "b"), (200, 701, 9, "c"), (202, 690, 9, "d"), (80, 650, 9, "in")])
    rows = L.structured_rows(b, L.column_clusters(b)).orderBy(F.desc("band")).collect()
    assert [(r.y, r.indent_level, r.cells) for r in rows] == [(700.0, 0, ["a", "c"]), (690.0, 0, ["b", "d"]), (650.0, 3, ["in", ""])]


def test_sections(spark):
    outline = spark.createDataFrame([(1, i, f"t{i}", s) for i, s in enumerate([1, 3, 3, 7, 5])], "doc_id long, node_ord int, title string, start int")
    ends = lambda rule: [r["end"] for r in D.section_ends(outline, F.lit(10), rule).orderBy("node_ord").collect()]
    assert ends("lead") == [2, 3, 6, 7, 10] and ends("next_greater") == [2, 6, 6, 10, 10]
    assert [tuple(r) for r in D.heading_pages(outline, F.lit(10), " T-1 ").collect()] == [(1, 1, "t1", 3, 6)]
    paras = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([("Heading1", "Intro"), (None, "p"), ("Heading1", "Intro more"), (None, "p"), ("Heading2", "Next"), (None, "p")])],
                                  "doc_id long, para_idx int, style_id string, text string")
    assert D.read_section(paras, "Intro").count() == 4 and D.read_section(paras, "none").count() == 0
    assert [r.para_idx for r in D.format_targets(paras, "all", body=True).orderBy("para_idx").collect()] == [1, 3, 5]
    with pytest.raises(Exception, match="no place 9"):
        D.insert_row(paras, 9, {"text": "x"}, strict=True).collect()


def test_addresses():
    base = "http://Ex.com:80/a/b?q#f"
    want = {"../up": "http://ex.com/up", "?x=1": "http://ex.com/a/b?x=1", "/ü,x?a=ö&b": "http://ex.com/%C3%BC,x?a=%C3%B6&b", "//O.com/x y": "http://o.com/x%20y", "HTTPS://Z.com": "https://z.com/",
            "./c/./d/..": "http://ex.com/a/c/", "data:a b": "data:a b", "%41 b": "http://ex.com/a/%41%20b", "http://[": None}
    assert {href: H.join(base, href) for href in want} == want


def test_tree_and_selectors():
    tree = H.parse("<ul><li>a<li>b<p>c<p>d</ul><table><tr><td>1<td>2<table><tr><td>n</table><tr><td>3</table><b>x</div>y<i id=k class='u v' data-z='1-2'>z")
    texts = lambda css: [n.text() for n in tree.select(H.Selector(css))]
    assert texts("li") == ["a", "bcd"] and texts("li > p") == ["c", "d"] and texts("td") == ["1", "2n", "n", "3"] and texts("td td") == ["n"]
    assert texts("#k") == texts(".u.v") == texts("i[data-z^='1']") == texts("b i[id=k], none") == ["z"] and texts("[data-z='1']") == []
    for bad in ("", "a:", "> ", "a,,b", "a[b"):
        with pytest.raises(ValueError):
            H.Selector(bad)


PAGE = """<title>T &amp; t</title><meta name=author content=' Me '><meta name=pubdate content=2026>
<ul><li><a href="/a"></a><a href='/a'>Title</a><a href="#x">Skip</a><a href='/b?x=1&amp;y=2'>Bee</a> [2026-03-09]</ul>
<article><h2>H</h2><p>some <b>bold</b> and <i>so</i>, longer than thirty <img data-src=i.png alt=pic><p><code>x</code><div class=ad>ad<div>in</div></div>
<ol><li>one<li>two<ul><li>deep</ul></ol><table><tr><th>A<th>A<tr><td>1<td>2<td>3</table></article>"""


def test_page(spark):
    p = spark.createDataFrame([(1, "http://h.com/x", PAGE), (None, None, None), (2, "no url", "")], "page_id long, url string, html string")
    one = lambda df: [tuple(r)[1:] for r in df.where("page_id = 1").collect()]
    assert one(W.links(p)) == [(1, "Bee", "http://h.com/b?x=1&y=2", "2026-03-09")]
    assert one(W.titles(p)) == [("T & t",)] and one(W.metas(p)) == [("Me", "2026")]
    assert one(W.tables(p)) == [(0, 0, {"A": "2", "col_3": "3"})]  # of equal headers the last cell stays
    assert one(W.cards(p, "li"))[0] == (1, "Title", "http://h.com/a", None, "Title Skip Bee  [2026-03-09]")
    assert one(W.articles(p))[0][3].startswith("<article><h2>H</h2><p>some <b>bold</b>") and 'src="http://h.com/i.png"' in one(W.articles(p))[0][3] and ">ad<" not in one(W.articles(p))[0][3]
    assert one(W.markdown(p))[0][1] == ("# T & t\n\n**作者**：Me  \n**发布时间**：2026  \n\n---\n\n## H\n\nsome **bold** and *so*, longer than thirty ![pic](http://h.com/i.png)\n\n`x`\n\n"
                                       "1. one\n2. two\n   - deep\n\n| A | A |\n| --- | --- |\n| 1 | 2 | 3 |")
    for operator in (W.titles, W.metas, W.article_text, W.markdown):
        assert operator(p).count() == 3 and operator(p.where("false")).count() == 0
    headed = spark.createDataFrame([(1, "<table><tr><th>A<th>B<tr><td>1<td>2<td>3</table>")], "page_id long, html string")
    assert one(W.tables(headed)) == [(0, 0, {"A": "1", "B": "2", "col_3": "3"})]


def test_router(spark):
    cases = [("https://youtube.com/w", "out.pdf", None, "yt-dlp"), ("x", "out.xlsx", None, "aria2c"), ("x", "out.htm", None, "monolith"), ("x", "out.md", None, "markdown"),
             ("x", "a.mp4", None, "markdown"), ("x", "a.md", "raw", "aria2c"), ("x.MP4", "a.md", None, "yt-dlp"), (None, "d.ir/.csv", None, "markdown")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, output string, form string, engine string").orderBy("i")
    assert [r[0] for r in frame.select(W.route(F.col("url"), F.col("output"), F.col("form"))).collect()] == [c[3] for c in cases]
