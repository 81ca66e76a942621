"""Vectors where the rules break easily: nodes without pages, documents without sections, broken and deep pages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.functions import markdown as M
from foliomill.functions import text as T
from foliomill.operators import documents as D
from foliomill.operators import sheets as S
from foliomill.operators import web as W
from foliomill.plans import registry
from foliomill.sources import html as H


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sections_skip_nodes_without_a_page(spark):
    outline = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", None), (1, 2, "c", 4)], "doc_id int, node_ord int, title string, start int")
    ends = lambda rule: sorted(rows(D.section_ends(outline, F.lit(10), rule).select("node_ord", "start", "end")))
    assert ends("lead") == ends("next_greater") == [(0, 1, 3), (2, 4, 10)]
    assert rows(D.heading_pages(outline, F.lit(10), "b")) == [(1, 1, "b", 1, 3)]
    assert rows(D.heading_pages(outline, F.lit(10), "c")) == [(1, 2, "c", 4, 10)]
    beyond = spark.createDataFrame([(1, 0, "a", 12)], "doc_id int, node_ord int, title string, start int")
    assert rows(D.heading_pages(beyond, F.lit(10), "A")) == [(1, 0, "a", 12, 12)]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_next_greater(spark, block):
    rng = random.Random(block)
    data = [(d, i, rng.randrange(12)) for d in range(4) for i in range(rng.randrange(1, 150))]
    want = sorted((d, i, next((w for e, j, w in data if e == d and j > i and w > v), None)) for d, i, v in data)
    got = D.next_greater(spark.createDataFrame(data, "doc_id int, node_ord int, start int"), "start", "out", block=block)
    assert sorted(rows(got.select("doc_id", "node_ord", "out"))) == want


def test_chunks_fall_back_by_document(spark):
    pages = spark.createDataFrame([(1, 1, " one "), (1, 2, "two"), (2, 1, "x" * 30), (2, 2, None), (2, 3, "y"), (3, 1, "a"), (3, 2, "b")], "doc_id int, page int, text string")
    outline = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "B", None), (1, 2, "C", 2), (3, 0, "far", 9), (4, 0, "Z", 1)], "doc_id int, node_ord int, path string, start int")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id int")
    got = sorted(rows(D.chunk_documents(pages, outline, 20, 5, docs).drop("char_count", "token_estimate")))
    whole = "Document / SlidingWindow"
    assert got == [(1, 0, "A", 1, 1, "one"), (1, 1, "C", 2, 2, "two"), (2, 0, whole, 1, 3, "x" * 20), (2, 1, whole, 1, 3, "x" * 15 + "\n\n\n\ny"), (3, 0, whole, 1, 2, "a\n\nb"), (4, 0, whole, 1, 0, "")]
    plan = D.chunk_documents(pages, outline)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # pages and outline, once each


def test_sections_of_all_user_turns(spark, tmp_path):
    """Every user turn is a section, whatever the length of its text."""
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * (5 * (t % 3))) for t in range(12)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["section_pages_next_greater"](spark, str(tmp_path))
    assert sorted(rows(found.select("node_ord", "page", "last_page"))) == [(t, t - t % 4, t - t % 4 + 3 if t < 8 else 100) for t in range(0, 12, 2)]


def test_numbers_without_a_point_head_no_lines(spark, tmp_path):
    """As in SQL: a long number is no heading because a full stop ends its line."""
    text = "a\nb\n4071467014155185 Thshenly thenea.\n12 x\nc\nd\n3.1 y."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["likely_headings"](spark, str(tmp_path)).where("para_idx % 3 = 2")
    assert rows(found.select("para_idx", "text")) == []
    head = "\n### {}\n".format
    want = "\n".join([head("1.2 a"), "b", "4071467014155185 Thshenly thenea.", "12 x", head("1.2 c"), "d", head("3.1 y.")])
    assert registry.QUERIES["text_to_md"](spark, str(tmp_path)).first()["text"] == want


def test_references_without_a_semicolon(spark, tmp_path):
    """As in SQL they are text in the queries; browsers read some of them, and so do the operators."""
    html = "<html><head><script>a&amp=b</script></head><body><article><h1>Thnd and&amp</h1><p>&quot;x&quot; &amp; y &copy; &copyx; &am &#65; & <a href='/p?a&amp;b'>link&amp</a></p></article></body></html>"
    spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    of = lambda name, column: registry.QUERIES[name](spark, str(tmp_path)).first()[column]
    assert of("page_title", "title") == of("page_markdown", "title") == "Thnd and&amp"
    assert of("page_markdown", "head") == "# Thnd and&amp\n\n# Thnd and&amp"
    assert of("page_article_text", "text") == 'Thnd and&amp"x" & y © &copyx; &am A & link&amp'
    assert (of("page_links", "title"), of("page_links", "url")) == ("link&amp", "http://a.com/p?a&b")
    assert H.parse(html, closed=True).first(H.Selector("script")).text() == "a&amp=b"
    assert rows(W.titles(spark.read.parquet(f"{tmp_path}/pages.parquet"))) == [(1, "Thnd and&")]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_next_pages_by_blocks(spark, block):
    rng = random.Random(block)
    data = [(d, i, rng.choice([None, *range(12)])) for d in range(4) for i in rng.sample(range(300), 120)]
    want = sorted((d, i, v, min(later)[1]) for d, i, v in data if v is not None and (later := [(j, w) for e, j, w in data if e == d and j > i and w is not None and w > v]))
    outline = spark.createDataFrame(data, "doc_id int, node_ord int, start int")
    spots = outline.where("start IS NOT NULL").select(F.col("doc_id").alias("_at"), F.col("node_ord").alias("_from"), F.col("start").alias("_page"))
    assert sorted(rows(D._next_pages(outline, spots, block))) == want


def test_equal_queries_are_looked_for_once(spark):
    """Repeated queries meet the titles once, each id gets its rows, and no hit meets the nodes of its whole document."""
    outline = spark.createDataFrame([(1, i, f"part {i}", i + 1) for i in range(40)], "doc_id int, node_ord int, title string, start int")
    asked = spark.createDataFrame([(q, "part") for q in range(50)], "query_id int, query string")
    found = D.heading_pages_by(outline, asked, F.lit(99))
    assert sorted(rows(found.select("doc_id", "query_id", "node_ord", "page_from", "page_to"))) == [(1, q, 0, 1, 1) for q in range(50)]
    assert D.matching_titles(outline.select("title"), asked).count() == 2000  # pairs of ids and titles, which no longer arise


def test_page_workers_hold_few_rows():
    """Batches of any size are cut, and every row comes through."""
    whole = [pa.RecordBatch.from_pydict({"page_id": list(range(n))}) for n in (1000, 0, 3)]
    cut = list(W._small(iter(whole)))
    assert max(b.num_rows for b in cut) == 128 and [i for b in cut for i in b.column(0).to_pylist()] == [*range(1000), *range(3)]


def test_titles_by_a_table_of_queries(spark):
    titles = ["Chapter One", "", None, "intro", "a", "Ünï—cödé", "Chapter One", "!!", "one"]
    queries = ["chapter", "ONE", "The intro to it", "", " ", "ünïcödé", "zz", "!", "a"]
    outline = spark.createDataFrame([(i % 2, i, t, i or None) for i, t in enumerate(titles)], "doc_id int, node_ord int, title string, start int")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = sorted(rows(D.heading_pages_by(outline, asked, F.lit(20)).select("query_id", "doc_id", "node_ord", "title", "page_from", "page_to")))
    want = sorted((i, *r) for i, q in enumerate(queries) for r in rows(D.heading_pages(outline, F.lit(20), q)))
    assert got == want and len(got) == 6


def test_contained_strings(spark):
    rng = random.Random(3)
    word = lambda: "n" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
    a, b = {word() for _ in range(40)}, {word() for _ in range(60)} | {"xabab"}
    frame = lambda s: spark.createDataFrame([(x,) for x in s], "s string")
    assert sorted(rows(D.contained(frame(a), frame(b)))) == sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1:] in y[1:])


RUNS = [
    ("plain", [("plain", 0, 0, 0)]), ("**b** and *i*", [("b", 1, 0, 0), (" and ", 0, 0, 0), ("i", 0, 1, 0)]), ("***x*** `c*d*`", [("x", 1, 1, 0), (" ", 0, 0, 0), ("c*d*", 0, 0, 1)]),
    ("a * b", [("a * b", 0, 0, 0)]), ("**open *in* more", [("**open ", 0, 0, 0), ("in", 0, 1, 0), (" more", 0, 0, 0)]), ("**a *b* c**", [("a ", 1, 0, 0), ("b", 1, 1, 0), (" c", 1, 0, 0)]),
    ("snake_case_name _it_", [("snake_case_name ", 0, 0, 0), ("it", 0, 1, 0)]), (r"\*no\* __yes__", [("*no* ", 0, 0, 0), ("yes", 1, 0, 0)]), ("[a **b**](u) ![p](q)", [("a ", 0, 0, 0), ("b", 1, 0, 0), (" p", 0, 0, 0)]), ("", []), (None, []),
    ("*a **b* c**", [("a **b", 0, 1, 0), (" c**", 0, 0, 0)])]


def test_markdown_runs(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RUNS)], "i int, t string")
    got = {r.i: [(x.text, int(x.bold), int(x.italic), int(x.code)) for x in r.runs] for r in frame.select("i", M.inline_runs(F.col("t")).alias("runs")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(RUNS)}


def test_style_of_a_range(spark):
    styles = spark.createDataFrame([("f", "S", 0, 1, True, 14.0), ("f", "S", 2, 0, False, 11.0), ("f", "T", 0, 0, True, 9.0), ("g", "S", 9, 9, True, 9.0)], "path string, sheet string, row int, col int, bold boolean, size double")
    got = sorted(rows(S.style_range(styles, "B1:A2", "S").select("path", "coord", "status", "size")))
    assert got == [("f", "A1", "empty_or_default", None), ("f", "A2", "empty_or_default", None), ("f", "B1", "formatted", 14.0), ("f", "B2", "empty_or_default", None),
                   ("g", "A1", "empty_or_default", None), ("g", "A2", "empty_or_default", None), ("g", "B1", "empty_or_default", None), ("g", "B2", "empty_or_default", None)]


def test_spans_pairs_and_strict_edits(spark):
    paras = spark.createDataFrame([(1, 0, "aXaXa"), (1, 1, "XX"), (2, 0, "no")], "doc_id int, para_idx int, text string")
    assert sorted(rows(D.highlight_spans(paras, "X").select("doc_id", "para_idx", "span_start", "span_end"))) == [(1, 0, 1, 2), (1, 0, 3, 4), (1, 1, 0, 1), (1, 1, 1, 2)]
    got = spark.range(1).select(T.key_values(F.lit("a=1,b = x ,a=2,=e,c,a = 3=4")).alias("m")).first().m
    assert got == {"a": "3=4", "b": "x", "": "e"}
    assert D.delete_row(paras, 1).count() == 2
    with pytest.raises(Exception, match="no para_idx 1 in 2"):
        D.delete_row(paras, 1, strict=True).collect()
    cells = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 1, "b")], "doc_id int, row int, col int, value string")
    assert sorted(r.value for r in D.set_cell(cells, 0, 0, "new").collect()) == ["b", "new"]
    with pytest.raises(Exception, match="no cell 0, 0 in 2"):
        D.set_cell(cells, 0, 0, "new", strict=True).collect()
    assert D.delete_row(paras, 0, strict=True).count() == 1


DEEP = 50_000
SHALLOW = [(2, "http://[x", "<h1>broken url</h1><a href=a>relative</a><a href='http://ok.com/b'>whole</a>"), (3, None, None)]
PAGES = [(1, "http://h.com/x", "<body>" + "<div>" * DEEP + "deep text of more than thirty characters<a href=y>link</a>"), (4, "http://h.com", "<article>" + "<b>" * DEEP + "words of an article that is long enough")]
OPERATORS = [W.links, W.titles, W.metas, W.article_text, W.tables, W.articles, W.markdown, lambda p, mode=None: W.cards(p, "a", mode=mode)]


@pytest.mark.parametrize("operator", OPERATORS)
def test_modes_and_broken_addresses(spark, operator):
    pages = spark.createDataFrame(SHALLOW, "page_id int, url string, html string").coalesce(1)
    for mode in (None, "PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        out = operator(pages, mode=mode)
        got = out.collect()
        assert ("error" in out.columns) == (mode == "PERMISSIVE") and all(mode != "PERMISSIVE" or r.error is None for r in got)
    if operator is W.links:
        assert [(r.page_id, r.url) for r in got] == [(2, "http://ok.com/b")]


def test_deep_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    assert [(r.page_id, r.url) for r in W.links(pages).collect()] == [(1, "http://h.com/y")]
    assert sorted(r.text for r in W.article_text(pages).collect()) == ["deep text of more than thirty characterslink", "words of an article that is long enough"]
    assert W.titles(pages).count() == 2 and W.tables(pages).count() == 0 and W.cards(pages, "a").count() == 1
    assert "deep text" in W.markdown(pages.where("page_id = 1")).first().content


def test_pages_that_cannot_be_read(spark, monkeypatch):
    """A page on which the parser fails gives an error row, no row, or an error."""
    pages = spark.createDataFrame([(1, None, "<a href='http://a.b/c'>fine</a>"), (2, None, "<p>bad</p>")], "page_id int, url string, html string")

    def broken(pages, mode):
        def rows(tree, url):
            if "bad" in tree.text():
                raise ValueError("bad page")
            yield (tree.text(),)

        return W._parsed(pages, rows, "text string", mode)

    assert [r.page_id for r in broken(pages, None).collect()] == [1] and broken(pages, "DROPMALFORMED").count() == 1
    assert sorted((r.page_id, r.error) for r in broken(pages, "PERMISSIVE").collect()) == [(1, None), (2, "ValueError: bad page")]
    with pytest.raises(Exception, match="page 2: bad page"):
        broken(pages, "FAILFAST").collect()
    with pytest.raises(ValueError):
        W.links(pages, mode="none")
