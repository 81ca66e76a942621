"""Readers of containers, on tiny files written here."""

import zipfile
import zlib

import pytest

from foliomill.operators import documents, layout, sheets
from foliomill.sources import containers, docx, markdown, pdf, xlsx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def cell(text):
    return f"<w:tc><w:p>{run(text)}</w:p></w:tc>"


DOCUMENT = (f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr>{run("Intro")}</w:p>'
            f'<w:p>{run("split ")}{run("run", "<w:highlight w:val=&quot;yellow&quot;/>".replace("&quot;", chr(34)))}</w:p>'
            f'<w:tbl><w:tr>{cell(" a ")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("")}</w:tr></w:tbl>'
            '<w:p><w:r><w:br w:type="page"/><w:t>next</w:t><w:tab/><w:t>col</w:t></w:r></w:p><w:p/></w:body></w:document>')
STYLES = (f'<w:styles {W}><w:style w:styleId="Heading1" w:type="paragraph" w:default="1"><w:name w:val="heading 1"/></w:style>'
          '<w:style w:styleId="X"><w:basedOn w:val="Y"/></w:style><w:style w:styleId="Empty"/></w:styles>')


def pack(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    pack(tmp_path / "mini.docx", {"word/document.xml": DOCUMENT, "word/styles.xml": STYLES})
    pack(tmp_path / "bad.docx", {"other.xml": "<a/>"})
    (tmp_path / "cut.docx").write_bytes((tmp_path / "mini.docx").read_bytes()[:60])
    (tmp_path / "empty.docx").write_bytes(b"")  # no bytes, no row
    rels = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    pack(tmp_path / "mini.xlsx", {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                           '<sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {rels}><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>word</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/a.xml": f'<worksheet {S}><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c><c r="AB3"/></row>'
                               '<row><c><v>7</v></c><c><v>1.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c><f>A1</f><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    (tmp_path / "notes.md").write_text("# One #\nfirst **bold**\nline `x`\n\n- item [text](u)\n### Three\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n# code\n```\n")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r)[1:] for r in df.where("error is null").drop("error", "error_type").collect()), key=repr)


def test_docx(spark, folder):
    assert rows(docx.read_paragraphs(spark, folder)) == [
        (0, "Heading1", "Intro"), (1, None, "split run"), (2, None, " a "), (3, None, "b"), (4, None, "1"), (5, None, ""), (6, None, "next\tcol")]  # <w:p/> has no ordinal
    assert rows(docx.read_table_cells(spark, folder)) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, "")]
    assert rows(docx.read_runs(spark, folder)) == [
        (0, 0, "Intro", None, False), (1, 0, "split ", None, False), (1, 1, "run", "yellow", False), (2, 0, " a ", None, False), (3, 0, "b", None, False), (4, 0, "1", None, False),
        (5, 0, "", None, False), (6, 0, "next\tcol", None, True)]
    assert [r.text for r in documents.highlighted(docx.read_runs(spark, folder)).collect()] == ["run"]
    assert rows(docx.read_styles(spark, folder)) == [("Heading1", "heading 1", "paragraph", True), ("X", "X", "paragraph", False)]


def test_bad_files_give_error_rows(spark, folder):
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in docx.read_paragraphs(spark, folder).where("error is not null").collect()}
    assert set(errors) == {"bad.docx", "cut.docx"}
    assert errors["bad.docx"].startswith("KeyError") and errors["cut.docx"].startswith("BadZipFile")
    kinds = {r["path"].rsplit("/", 1)[1]: r["error_type"] for r in docx.read_paragraphs(spark, folder).where("error is not null").collect()}
    assert kinds == {"bad.docx": "missing_part", "cut.docx": "corrupted_document"}
    read = lambda mode: containers.scan(spark, folder, docx.paragraphs, docx.PARAGRAPHS, "*.docx", mode)
    assert read("DROPMALFORMED").where("error is not null").count() == 0 and read("DROPMALFORMED").count() == 7
    with pytest.raises(Exception, match="docx"):
        read("FAILFAST").collect()


DRAWN = (f'<w:document {W} xmlns:wp="wp" xmlns:a="a" xmlns:r="r"><w:body><w:p><w:r><w:drawing><wp:extent cx="3600000" cy="1800000"/><a:blip r:embed="rId7"/></w:drawing></w:r></w:p>'
         '<w:p><w:r><w:drawing><wp:extent cx="36000" cy="54000"/><a:blip r:embed="rId9"/></w:drawing></w:r></w:p><w:p><w:r><w:drawing><wp:extent cx="0" cy="9"/></w:drawing></w:r></w:p>'
         '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="16838" w:h="11906"/></w:sectPr></w:body></w:document>')


def test_docx_images_and_summary(spark, tmp_path):
    pack(tmp_path / "drawn.docx", {
        "word/document.xml": DRAWN, "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId7" Target="media/a.png"/></Relationships>',
        "word/media/a.png": "\x89PNG", "word/media/": "", "other.bin": "no"})
    images, rels = docx.read_images(spark, str(tmp_path)), docx.read_relations(spark, str(tmp_path))
    named = documents.image_targets(images.drop("error", "error_type"), rels).orderBy("img_idx")
    assert [(r.rel_id, r.width_mm, r.height_mm, r.filename) for r in named.collect()] == [("rId7", 100.0, 50.0, "media/a.png"), ("rId9", 1.0, 1.5, "image_1.bin")]
    assert [(r.name, bytes(r.content)) for r in docx.read_media(spark, str(tmp_path)).collect()] == [("a.png", "\x89PNG".encode())]
    assert rows(docx.read_summary(spark, str(tmp_path))) == [(4, 1, 2, 0, 1, "landscape", "A4")]


def pdf_file(objects, trailer="/Root 1 0 R"):
    out, places = bytearray(b"%PDF-1.5\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} {trailer} >>\nstartxref\n{at}\n%%EOF".encode())


def stream(data, extra=""):
    return f"<< /Length {len(data)} {extra} >>\nstream\n".encode() + data + b"\nendstream"


CONTENT = b"""BT /F1 12 Tf 100 700 Td (World) Tj ET BT /F1 12 Tf 1 0 0 1 10 700 Tm [(Hel) -20 (lo)] TJ 0 -14 Td <0001000200> Tj ET
BI /W 1 /H 1 ID \x00\xff EI BT 10 650 Td (p\\(a\\051r\\
a) Tj ET (outside) Tj"""
CMAP = b"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n1 beginbfchar\n<0001> <4E2D>\nendbfchar 2 beginbfrange\n<0002> <0003> [<6587> <0041>] <0010> <0012> <0061>\nendbfrange"
PDF = [
    "<< /Type /Catalog /Pages 2 0 R /Outlines 8 0 R >>", "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R >> >> >>",
    "<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Rotate -90 >>", "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 842 595] /Contents [7 0 R] >>",
    "<< /Type /Font /ToUnicode 12 0 R >>", stream(zlib.compress(CONTENT), "/Filter /FlateDecode"), stream(b"BT (two) Tj ET"),
    "<< /First 9 0 R >>", "<< /Title (One) /Dest [3 0 R /Fit] /First 10 0 R /Next 11 0 R >>", "<< /Title <FEFF4E2D> /A << /D [1 /Fit] >> /Next 9 0 R >>", "<< /Dest (named) >>",
    stream(CMAP),
]


def test_pdf(spark, tmp_path):
    whole = pdf_file(PDF)
    (tmp_path / "mini.pdf").write_bytes(whole)
    (tmp_path / "locked.pdf").write_bytes(pdf_file(PDF, "/Root 1 0 R /Encrypt << >>"))
    (tmp_path / "none.pdf").write_bytes(b"no pdf at all")
    where = str(tmp_path)
    assert rows(pdf.read_pages(spark, where)) == [(1, 612.0, 792.0, 270), (2, 842.0, 595.0, 0)]
    assert rows(pdf.read_outline(spark, where)) == [(0, None, 1, "One", "One", 1), (1, 0, 2, "中", "One / 中", 2), (2, None, 1, pdf.NO_TITLE, pdf.NO_TITLE, None)]
    elements = pdf.read_elements(spark, where).where("error is null")
    assert sorted((r.page, r.elem_ord, r.x, r.y, r.text, r.font_size) for r in elements.collect()) == [
        (1, 0, 100.0, 700.0, "World", 12.0), (1, 1, 10.0, 700.0, "Hello", 12.0), (1, 2, 10.0, 686.0, "中文\ufffd", 12.0), (1, 3, 10.0, 650.0, "p(a)ra", 12.0), (2, 0, 0.0, 0.0, "two", 10.0)]
    lines = layout.page_text(layout.text_lines(elements.withColumnRenamed("path", "doc_id")))
    assert {r.page: r.text for r in lines.collect()} == {1: "Hello World\n中文\ufffd\n\np(a)ra", 2: "two"}
    assert {r["path"].rsplit("/", 1)[1]: r["error_type"] for r in pdf.read_info(spark, where).where("error is not null").collect()} == {"locked.pdf": "encrypted", "none.pdf": "corrupted_document"}
    assert rows(pdf.read_info(spark, where)) == [("1.5", 2, None, None)]
    broken = whole.replace(b"startxref", b"startxxxx")
    assert list(pdf.elements(broken)) == list(pdf.elements(whole)) and list(pdf.outline(broken)) == list(pdf.outline(whole))


def test_pdf_streams_of_objects_and_references():
    packed = [(1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Kids [3 0 R] >>"), (3, "<< /Type /Page /Contents 5 0 R >>")]
    heads, bodies = "", ""
    for n, body in packed:
        heads += f"{n} {len(bodies)} "
        bodies += body + " "
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj\n" + stream(zlib.compress((heads + bodies).encode()), f"/Type /ObjStm /N 3 /First {len(heads)} /Filter /FlateDecode") + b"\nendobj\n"
    at5 = len(out)
    out += b"5 0 obj\n" + stream(b"4254202868692920546a204554>", "/Filter [/ASCIIHexDecode]") + b"\nendobj\n"
    at6 = len(out)
    table = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    above, filtered = bytes(4), b""
    for kind, a, b in table:  # PNG rows, each the difference to the one above
        row = bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
        filtered += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    out += b"6 0 obj\n" + stream(zlib.compress(filtered), "/Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\n"
    whole = bytes(out) + f"startxref\n{at6}\n%%EOF".encode()
    assert [r[:5] for r in pdf.elements(whole)] == [(1, 0, 0.0, 0.0, "hi")]
    assert list(pdf.pages(whole)) == [(1, 595.28, 841.89, 0)]


def test_pdf_text_by_its_bytes():
    assert [pdf.decode(b, {}) for b in (b"\xfe\xff\x00A", "é".encode(), b"\x00\xe9\x00b", b"a\xe9b")] == ["A", "é", "éb", "a?b"]
    assert pdf.unicode_map(CMAP) == {1: "中", 2: "文", 3: "A", 16: "a", 17: "b", 18: "c"} and pdf.decode(b"\x00\x01\x10z\x07", pdf.unicode_map(CMAP)) == "中az\ufffd"


def test_xlsx(spark, folder):
    assert rows(xlsx.read_cells(spark, folder)) == sorted([
        (0, "One", 2, 1, "string", "word"), (0, "One", 2, 26, "string", "rich"), (0, "One", 3, 0, "int", "7"), (0, "One", 3, 1, "float", "1.5"),
        (0, "One", 3, 2, "bool", "true"), (0, "One", 3, 3, "error", "#N/A"), (0, "One", 3, 4, "int", "2"), (1, "Two", 0, 0, "string", "in")], key=repr)


def test_xlsx_sheets_and_styles(spark, folder, tmp_path):
    names = xlsx.read_sheets(spark, folder).drop("path", "error", "error_type")
    assert sorted(map(tuple, names.collect())) == [(0, "One"), (1, "Two")]
    order = lambda df: [r.sheet for r in df.orderBy("sheet_ord").collect()]
    assert order(sheets.manage_sheet(names, "add", "New")) == ["One", "Two", "New"] and order(sheets.manage_sheet(names, "add", "Two")) == ["One", "Two"]
    assert order(sheets.manage_sheet(names, "remove", "One")) == ["Two"] and order(sheets.manage_sheet(names, "rename", "One", "Uno")) == ["Uno", "Two"]
    with pytest.raises(ValueError):
        sheets.manage_sheet(sheets.manage_sheet(names, "remove", "One"), "remove", "Two")
    rels = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    pack(tmp_path / "styled.xlsx", {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {rels}><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>',
        "xl/worksheets/a.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" s="1"><v>1</v></c><c r="B1"><v>2</v></c></row></sheetData></worksheet>',
        "xl/styles.xml": f'<styleSheet {S}><fonts><font/><font><b/><sz val="14"/><name val="Arial"/><color rgb="FF112233"/></font></fonts><fills><fill/></fills><borders><border/></borders>'
                         '<cellXfs><xf/><xf fontId="1" fillId="0" borderId="0"><alignment horizontal="center"/></xf></cellXfs></styleSheet>'})
    one = xlsx.read_cell_styles(spark, f"{tmp_path}/styled.xlsx").drop("path", "error", "error_type").collect()
    assert [tuple(r) for r in one] == [(0, "One", 0, 0, True, 14.0, "Arial", "FF112233", None, "center", "bottom", False)]
    lines = spark.createDataFrame([("s", 1, ["b", None]), ("s", 0, ['a,"', "é"])], "sheet string, row int, vals array<string>")
    missing = sheets.search(lines, "a", sheet="none")  # an error when it runs, not when it is planned
    with pytest.raises(Exception, match="no sheet 'none'"):
        missing.collect()
    assert [r.matched_value for r in sheets.search(lines, "b", sheet="s").collect()] == ["b"]


def test_markdown(spark, folder):
    assert rows(markdown.read_blocks(spark, folder)) == [
        (0, "heading", 1, "One"), (1, "paragraph", None, "first bold line x"), (2, "item", None, "item text"), (3, "heading", 3, "Three"),
        (4, "table_row", None, "a\tb"), (5, "table_row", None, "1\t2"), (6, "code", None, "# code")]
    assert list(markdown.blocks(b"")) == []
