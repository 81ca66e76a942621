"""Filters pushed into container readers, several relations from one parse, and files written by tasks."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from foliomill.sources import containers, docx, pushdown, relations, sinks, xlsx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def book(path, broken_first=False):
    sheet = lambda text: f'<worksheet {S}><sheetData>' + "".join(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t> {text}{r} </t></is></c><c r="B{r}" s="1"><v>45000.25</v></c></row>' for r in (1, 2, 3)) + "</sheetData></worksheet>"
    names = ["One", "Two", "Three"]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {RELS}>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(3)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {S}><numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", "<broken" if broken_first and not i else sheet(n))


def document(path, text="x"):
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = lambda t: f"<w:tbl><w:tr><w:tc>{para(t)}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{para(text)}{table('a')}{table('b')}<w:sectPr/></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="h"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships {RELS}><Relationship Id="r1" Target="media/a.png"/></Relationships>')
        z.writestr("word/media/a.png", b"png")


@pytest.fixture
def opened(monkeypatch):
    """The parts that are inflated in this process."""
    names, read = [], containers.Package.read

    def counted(self, name):
        names.append(name)
        return read(self, name)

    monkeypatch.setattr(containers.Package, "read", counted)
    return names


def test_filters_skip_parts(tmp_path, opened):
    book(tmp_path / "b.xlsx")
    reader = pushdown.Cells({"files": json.dumps([f"file://{tmp_path}/b.xlsx"])}).reader(None)
    left = list(reader.pushFilters([EqualTo(("sheet",), "Two"), GreaterThan(("row",), 0), In(("kind",), ("string",))]))
    assert [type(f) for f in left] == [In]  # the kind isn't a part's name
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1:7] for r in rows] == [(1, "Two", 1, 0, "string", "Two2"), (1, "Two", 1, 1, "date", "45000.2500"), (1, "Two", 2, 0, "string", "Two3"), (1, "Two", 2, 1, "date", "45000.2500")]
    assert sorted(n for n in opened if "worksheets" in n) == ["xl/worksheets/s1.xml"]
    none = pushdown.Cells({"files": json.dumps([f"file://{tmp_path}/b.xlsx"])}).reader(None)
    assert not list(none.pushFilters([EqualTo(("sheet",), "Nine")])) and not list(none.read(none.partitions()[0]))
    assert opened.count("xl/styles.xml") == 1  # not for a sheet that isn't there


def test_filters_skip_media_and_tables(tmp_path, opened):
    document(tmp_path / "d.docx")
    option = {"files": json.dumps([f"file://{tmp_path}/d.docx"])}
    media = pushdown.Media(option).reader(None)
    list(media.pushFilters([EqualTo(("name",), "none.png")]))
    assert not list(media.read(media.partitions()[0])) and opened == []
    tables = pushdown.TableCells(option).reader(None)
    list(tables.pushFilters([EqualTo(("table_idx",), 1)]))
    assert [r[1:5] for r in tables.read(tables.partitions()[0])] == [(1, 0, 0, "b")]


def test_pushdown_through_spark(spark, tmp_path):
    book(tmp_path / "b.xlsx", broken_first=True)
    book(tmp_path / "c.xlsx")
    (tmp_path / "cut.xlsx").write_bytes((tmp_path / "c.xlsx").read_bytes()[:80])
    cells = pushdown.open_source(spark, "folio_cells", str(tmp_path))
    two = cells.where("sheet = 'Two' AND row BETWEEN 1 AND 1 AND kind = 'string'")
    assert sorted(r.value for r in two.collect()) == ["Two2", "Two2"]  # the broken sheet is never parsed
    errors = cells.where("error IS NOT NULL").select("error_type").collect()
    assert sorted(r.error_type for r in errors) == ["corrupted_document", "xml_parse"]
    assert cells.where("sheet = 'One'").count() == 6  # of the whole file; the broken one has no row
    dropped = pushdown.open_source(spark, "folio_cells", str(tmp_path), "DROPMALFORMED")
    assert dropped.count() == 18
    with pytest.raises(Exception, match="xlsx"):
        pushdown.open_source(spark, "folio_cells", str(tmp_path), "FAILFAST").collect()
    plain = xlsx.read_cells(spark, f"{tmp_path}/c.xlsx").drop("path").collect()
    assert sorted(plain) == sorted(pushdown.open_source(spark, "folio_cells", f"{tmp_path}/c.xlsx").drop("path").collect())


@pytest.mark.parametrize(("code", "date"), [("yyyy-mm-dd", True), ("0.00", False), ("General", False), ("[h]:mm", True), ('"day "0', False), ("[Red]0.0", False), ("h:mm AM/PM", True), ("0\\d", False), ("[$-409]d-mmm", True), ("#,##0;[Red]d", False)])
def test_date_codes(code, date):
    assert xlsx.is_date_code(code) == date


def test_one_parse_for_all_relations(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        document(source / f"{i}.docx", f"text {i}")
    (source / "bad.docx").write_bytes(b"no zip")
    relations.extract(spark, str(source), out)
    opened = relations.relation(spark, out, "parts").groupBy("part").agg(F.count("*").alias("files"), F.max("times").alias("most")).collect()
    assert {(r.part, r.files, r.most) for r in opened} == {("word/document.xml", 3, 1), ("word/styles.xml", 3, 1), ("word/_rels/document.xml.rels", 3, 1)}
    for kind, read in [("paragraphs", docx.read_paragraphs), ("runs", docx.read_runs), ("table_cells", docx.read_table_cells), ("styles", docx.read_styles), ("relations", docx.read_relations), ("summary", docx.read_summary), ("images", docx.read_images)]:
        want = read(spark, str(source)).where("error IS NULL").drop("error", "error_type")
        got = relations.relation(spark, out, kind)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert {r.f.rsplit("/", 2)[1] for r in got.select(F.input_file_name().alias("f")).collect()} <= {f"kind={kind}"}  # its own partition only
    assert [r.error_type for r in relations.relation(spark, out, "errors").collect()] == ["corrupted_document"]
    few = str(tmp_path / "few")
    relations.extract(spark, str(source), few, ["styles"], "DROPMALFORMED")
    assert {r.part for r in relations.relation(spark, few, "parts").collect()} == {"word/styles.xml"}
    plan = relations.relation(spark, out, "paragraphs").select("text")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "struct<paragraphs:struct<text:string>>" in plan.replace("path:string,", "")
    with pytest.raises(ValueError):
        relations.extract(spark, str(source), few, ["none"])


def test_csv_of_each_sheet(spark, tmp_path):
    lines = spark.createDataFrame([("s", 1, ["b", None]), ("s", 0, ['a,"', "é"]), ("t/u", 0, ["x"])] + [("long", i, [str(i)]) for i in range(5000)], "sheet string, row int, vals array<string>").repartition(7)
    sinks.write_csv(lines, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["long.csv", "s.csv", "t_u.csv"]
    assert (tmp_path / "out/s.csv").read_bytes() == b'\xef\xbb\xbf"a,""",\xc3\xa9\nb,\n'
    assert (tmp_path / "out/long.csv").read_text("utf-8-sig") == "".join(f"{i}\n" for i in range(5000))
    with pytest.raises(Exception, match="s.csv|long.csv|t_u.csv"):  # files that are there stay
        sinks.write_csv(lines, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["long.csv", "s.csv", "t_u.csv"]
    sinks.write_csv(lines.where("sheet = 's'").withColumn("row", -F.col("row")), f"{tmp_path}/out", overwrite=True)
    assert (tmp_path / "out/s.csv").read_bytes() == b'\xef\xbb\xbfb,\n"a,""",\xc3\xa9\n'


def test_json_and_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", None), (2, "é", [1, 2])], "doc_id long, text string, ids array<int>")
    sinks.write_json(docs, f"{tmp_path}/json")
    assert json.loads((tmp_path / "json/1.json").read_text()) == {"doc_id": 1, "text": "a\nb", "ids": None}
    sinks.write_markdown(docs, f"{tmp_path}/md", "doc_id", "text")
    assert (tmp_path / "md/2.md").read_text() == "é" and len(list((tmp_path / "md").iterdir())) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_files(rows, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
