"""Object graphs of tiny PDF files: images by page, outlines by their links, and circles."""

import hashlib

from pyspark.sql import functions as F

from foliomill.operators import graphs
from foliomill.sources import pdf, pdf_graph


def write(path, objects, streams=()):
    out = b"%PDF-1.4\n"
    for n, body in objects.items():
        out += f"{n} 0 obj\n{body}\nendobj\n".encode()
    for n, head, raw in streams:
        out += f"{n} 0 obj\n<<{head} /Length {len(raw)}>>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    path.write_bytes(out + b"trailer\n<</Root 1 0 R>>\n")


OBJECTS = {
    1: "<</Type /Catalog /Pages 2 0 R /Outlines 30 0 R>>", 2: "<</Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /Resources <</XObject <</S 20 0 R>>>>>>",
    3: "<</Type /Page /Parent 2 0 R>>", 4: "<</Type /Page /Parent 2 0 R /Resources <</XObject <</F 21 0 R /A 22 0 R>>>>>>", 5: "<</Type /Page /Parent 2 0 R /Resources <</XObject <</A 22 0 R>>>>>>",
    30: "<</First 31 0 R>>", 31: "<</Title (One) /Parent 30 0 R /Next 33 0 R /First 32 0 R /Dest [4 0 R /Fit]>>", 32: "<</Title (One A) /Parent 31 0 R /A <</S /GoTo /D [5 0 R]>>>>",
    33: "<</Title (Two) /Parent 30 0 R /Next 34 0 R /Dest (named)>>", 34: "<</Title (Three) /Parent 30 0 R /Next 33 0 R>>"}
STREAMS = [(20, "/Subtype /Image /Width 2 /Height 1", b"shared"), (21, "/Subtype /Form /Resources <</XObject <</I 23 0 R /Again 21 0 R>>>>", b""), (22, "/Subtype /Image /Width 4 /Height 5 /Filter /DCTDecode", b"jpeg"),
           (23, "/Subtype /Image /Width 9 /Height 9", b"in a form"), (24, "/Width 1 /Height 1", b"orphan")]


def test_images_and_outline_of_a_file(spark, tmp_path):
    write(tmp_path / "a.pdf", OBJECTS, STREAMS)
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    found = pdf_graph.read_graph(spark, str(tmp_path))
    got = graphs.page_images(found["pages"], found["links"], found["images"]).orderBy("image_index").drop("doc_id").collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert [tuple(r) for r in got] == [(1, 0, 20, 2, 1, None, 6, sha(b"shared")), (2, 1, 22, 4, 5, "DCTDecode", 4, sha(b"jpeg")), (2, 2, 23, 9, 9, None, 9, sha(b"in a form")), (None, 3, 24, 1, 1, None, 6, sha(b"orphan"))]
    outline = graphs.target_pages(graphs.outline_order(found["items"]), found["destinations"], found["pages"])
    rows = [tuple(r) for r in outline.orderBy("node_ord").select("node_ord", "parent_ord", "level", "title", "path", "target_page").collect()]
    assert rows == [(0, None, 1, "One", "One", 2), (1, 0, 2, "One A", "One / One A", 3), (2, None, 1, "Two", "Two", None), (3, None, 1, "Three", "Three", None)]
    assert [r.title for r in pdf.read_outline(spark, f"{tmp_path}/a.pdf").orderBy("node_ord").collect()][:2] == ["One", "One A"]
    assert found["errors"].count() == 1


def test_long_chains_deep_trees_and_circles(spark):
    schema = "doc_id int, node int, title string, first int, next int"
    chain = [(1, 0, None, 1, None)] + [(1, i, f"t{i}", None, i + 1 if i < 100 else None) for i in range(1, 101)]
    deep = [(2, i, f"d{i}", i + 1 if i < 40 else None, None) for i in range(41)]
    circle = [(3, 0, None, 1, None), (3, 1, "a", None, 2), (3, 2, "b", None, 1), (3, 7, "lost", 8, None), (3, 8, "lost too", 7, None)]
    got = graphs.outline_order(spark.createDataFrame(chain + deep + circle, schema))
    assert [r.title for r in got.where("doc_id = 1").orderBy("node_ord").collect()] == [f"t{i}" for i in range(1, 101)]
    assert [(r.title, r.level) for r in got.where("doc_id = 2").orderBy("node_ord").collect()] == [(f"d{i}", i) for i in range(1, 41)]
    assert [r.title for r in got.where("doc_id = 3").orderBy("node_ord").collect()] == ["a", "b"]
    assert graphs.outline_order(spark.createDataFrame([], schema)).count() == 0
    none = spark.createDataFrame([], "doc_id int, page int, node int")
    assert graphs.page_images(none, none.select("doc_id", "node", F.col("page").alias("target")), none.select("doc_id", "node")).count() == 0
