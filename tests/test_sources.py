"""Parsers on files made here."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import markup, office, plain, reader, spans, tabular
from corvane.sources.decode import ParseError, decode, format_of


def archive(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def package(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_decode():
    assert decode("é\r\nx\ry".encode()) == ("é\nx\ny", False)
    assert decode("é".encode("cp1252")) == ("é", True)
    assert decode("é".encode("utf-16")) == ("é", False) and decode(b"\xfe\xff" + "é".encode("utf-16-be")) == ("é", False)
    assert decode(b"\xef\xbb\xbfx") == ("x", False)
    for data, kind in ((b"\0x", "invalid"), (b"\xef\xbb\xbf\xff", "encoding"), (b"x" * 11, "too_large")):
        with pytest.raises(ParseError) as e:
            decode(data, most=10)
        assert e.value.kind == kind


def test_format_of(spark):
    t = spark.createDataFrame([("a.PDF", None, "pdf"), ("a.md", None, "markdown"), ("a.bin", "text/csv; charset=x", "csv"), ("a.txt", "application/pdf", "pdf"), ("a", None, "unsupported")], "p string, m string, want string")
    assert t.where(format_of(F.col("p"), F.col("m")) != F.col("want")).count() == 0


def test_paragraphs_and_notes():
    text = "first line\nsecond\n\n  third é  \n\n\nlast"
    got = plain.paragraphs(text)
    assert [b["text"] for b in got] == ["first line\nsecond", "third é", "last"]
    assert all(text[b["first"] : b["last"]] == b["text"] for b in got)
    long = "\n".join(["x" * 300] * 12)
    assert all(len(b["text"]) <= 1000 and long[b["first"] : b["last"]] == b["text"] for b in plain.paragraphs(long))
    with pytest.raises(ParseError):
        plain.paragraphs(" \n ")
    assert plain.cleaned_note("﻿a  \r\n\r\n\r\n\r\nb\n") == "a\n\nb"
    assert plain.note_title("Title here\nbody") == "Title here" and plain.note_title("A sentence. " * 10).endswith("…")


def test_markdown():
    text = "---\ntitle: The Guide\nauthor: A\n---\nIntro *text* with [link](http://x).\n\n# One\n\n- a\n  - b\n1. c\n\n```python\nx = 1\n\ny\n```\n\n## Two\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quoted\n> more\n\nSet\n===\nend"
    meta, got = plain.markdown(text)
    assert meta["title"] == "The Guide" and meta["author"] == "A"
    assert [(b["kind"], b["text"], b["path"]) for b in got] == [
        ("paragraph", "Intro text with link.", []), ("heading", "One", ["One"]), ("list_item", "a", ["One"]), ("list_item", "b", ["One"]), ("list_item", "c", ["One"]),
        ("code", "x = 1\n\ny", ["One"]), ("heading", "Two", ["One", "Two"]), ("table", "a | b\n1 | 2", ["One", "Two"]), ("paragraph", "quoted more", ["One", "Two"]), ("heading", "Set", ["Set"]), ("paragraph", "end", ["Set"])]
    assert got[0]["first"] == 5 and got[5]["language"] == "python" and got[3]["depth"] == 1 and got[4]["ordered"]


def test_tabular():
    data = "nome;valor;data\na;1,5;2024-01-01\nb;\"2\n3\";2024-02-01\n;;\n\nc;1.234,5;2024-03-01;extra\n".encode()
    info, got = tabular.records(data)
    assert info["delimiter"] == ";" and info["header"] == "confident" and info["kinds"][2] == "date"
    assert [b["first"] for b in got] == [1, 2, 4]
    assert got[2]["fields"][3] == {"name": "Column 4", "value": "extra"}
    assert tabular.header_of([["1", "x"], ["2", "y"]]) == "absent" and tabular.header_of([["name", "city"], ["Ann", "Rome"]]) == "uncertain"
    assert tabular.header_of([["name", "name"], ["1", "2"]]) == "absent" and tabular.header_of([["", "n", "v"], ["1", "x", "3"], ["2", "y", "4"]]) == "confident"
    assert tabular.delimiter_of("a|b|c\n1|2|3\n") == "|" and tabular.delimiter_of("abc\nd\n") == "," and tabular.delimiter_of("a,b", "tsv") == "\t"


def test_xhtml():
    html = "<html><head><title>no</title></head><body><nav>no</nav><h1>One</h1><p>a <b>b</b><br/>c</p><ul><li>x<ol><li>y</li></ol></li></ul><pre><code class='language-py'>\nx  = 1  \n</code></pre><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2<table><tr><td>3</td></tr></table></td></tr></table><h2>Two</h2>tail<script>no</script></body></html>"
    got = markup.xhtml(html)
    assert [(b["kind"], b["text"]) for b in got] == [
        ("heading", "One"), ("paragraph", "a b c"), ("list_item", "x"), ("list_item", "y"), ("code", "x  = 1"), ("table", "h | i\n1 | 23"), ("heading", "Two"), ("paragraph", "tail")]
    assert got[3]["ordered"] and got[3]["depth"] == 1 and got[4]["language"] == "py" and got[5]["header"] == ["h", "i"] and got[7]["path"] == ["One", "Two"]


def epub_files():
    return {
        "META-INF/container.xml": "<container xmlns='urn:x'><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></container>",
        "O/p.opf": "<package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest>"
        "<item id='n' href='nav.xhtml' properties='nav' media-type='application/xhtml+xml'/><item id='a' href='a%20b.xhtml'/><item id='b' href='b.xhtml'/><item id='c' href='c.xhtml'/></manifest>"
        "<spine><itemref idref='n'/><itemref idref='a'/><itemref idref='b' linear='no'/><itemref idref='c'/></spine></package>",
        "O/nav.xhtml": "<html xmlns='http://www.w3.org/1999/xhtml'><body><a href='a%20b.xhtml'>First</a></body></html>",
        "O/a b.xhtml": "<html><body><p>hello</p></body></html>", "O/b.xhtml": "<html><body><h1>Second</h1><h2>Deep</h2><p>more</p></body></html>", "O/c.xhtml": "<html><body><p>broken"}


def test_epub():
    meta, got, skipped = markup.epub(package(epub_files()))
    assert meta["title"] == "Book" and skipped == [3]
    assert [(b["text"], b["path"], b["first"]) for b in got] == [("hello", ["First"], 1), ("Second", ["Second"], 2), ("Deep", ["Second", "Deep"], 2), ("more", ["Second", "Deep"], 2)]
    with pytest.raises(ParseError) as e:
        markup.epub(package(epub_files() | {"META-INF/encryption.xml": "<e><EncryptionMethod Algorithm='aes'/></e>"}))
    assert e.value.kind == "drm"
    with pytest.raises(ParseError):
        markup.epub(b"no zip")


RELS = "<Relationships xmlns='r'><Relationship Id='r1' Type='x/officeDocument' Target='{}'/></Relationships>"


def test_docx():
    w = "xmlns:w='http://w'"
    body = (
        "<w:p><w:pPr><w:pStyle w:val='H'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:noBreakHyphen/><w:t>c</w:t></w:r></w:p>"
        "<w:p><w:pPr><w:numPr><w:ilvl w:val='0'/><w:numId w:val='1'/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    data = package({
        "_rels/.rels": RELS.format("word/document.xml"), "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": "<R xmlns='r'><Relationship Id='a' Type='x/styles' Target='styles.xml'/><Relationship Id='b' Type='x/numbering' Target='numbering.xml'/></R>",
        "word/styles.xml": f"<w:styles {w}><w:style w:styleId='H'><w:basedOn w:val='B'/></w:style><w:style w:styleId='B'><w:name w:val='heading 2'/></w:style></w:styles>",
        "word/numbering.xml": f"<w:numbering {w}><w:abstractNum w:abstractNumId='0'><w:lvl w:ilvl='0'><w:numFmt w:val='bullet'/></w:lvl></w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='0'/></w:num></w:numbering>",
        "docProps/core.xml": "<c xmlns:dc='d'><dc:title>T</dc:title></c>"})
    meta, got = office.docx(data)
    assert meta == {"title": "T"}
    assert [(b["kind"], b["text"]) for b in got] == [("heading", "Head"), ("paragraph", "a b-c"), ("list_item", "item"), ("record", "k: 1\nv: 2")]
    assert got[0]["level"] == 2 and not got[2]["ordered"] and got[3]["path"] == ["Head", "Table 1 (k, v)"]


def test_xlsx():
    sheet = (
        "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>When</t></is></c><c r='C1' t='inlineStr'><is><t>Name</t></is></c></row>"
        "<row r='2'><c r='A2'><v>1.5</v></c><c r='B2' s='1'><v>45352</v></c><c r='C2' t='b'><v>1</v></c></row><row r='4'><c r='A4'><v>7</v></c><c r='C4' t='e'><v>#N/A</v></c></row></sheetData></worksheet>")
    data = package({
        "_rels/.rels": RELS.format("xl/workbook.xml"),
        "xl/workbook.xml": "<workbook xmlns:r='q'><sheets><sheet name='S' r:id='a'/><sheet name='H' state='hidden' r:id='b'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<R><Relationship Id='a' Type='x/worksheet' Target='s.xml'/><Relationship Id='b' Type='x/worksheet' Target='s.xml'/><Relationship Id='c' Type='x/sharedStrings' Target='ss.xml'/><Relationship Id='d' Type='x/styles' Target='st.xml'/></R>",
        "xl/s.xml": sheet, "xl/ss.xml": "<sst><si><r><t>Amount</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/st.xml": "<s><numFmts><numFmt numFmtId='164' formatCode='dd/mm/yyyy'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='164'/></cellXfs></s>"})
    _, got, hidden = office.xlsx(data)
    assert hidden == ["H"] and [b["text"] for b in got] == ["Record 1\nAmount: 1.5\nWhen: 2024-03-01\nName: yes", "Record 2\nAmount: 7"]


def test_reader_keeps_going(spark):
    files = [("a.txt", b"one\n\ntwo"), ("b.md", b"# T\n\nx"), ("c.epub", b"broken"), ("d.pdf", b"%PDF"), ("e.epub", package(epub_files())), ("f.csv", b"a,b\n1,2\n3,4\n")]
    got = {r.path: r for r in reader.parsed(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert [b.text for b in got["a.txt"].blocks] == ["one", "two"] and got["b.md"].title == "T"
    assert got["c.epub"].error == "invalid" and got["d.pdf"].error == "unsupported" and got["e.epub"].warnings == ["skipped_unit 3"]
    assert got["f.csv"].error is None and len(got["f.csv"].blocks) == 2


def test_spans(spark):
    rows = []
    for page in range(1, 5):
        rows += [(1, page, "Report 2024", 10.0, 5.0, 90.0, 12.0, 8.0, False), (1, page, str(page), 50.0, 990.0, 55.0, 998.0, 8.0, False), (1, page, f"Title {page}", 10.0, 100.0, 60.0, 120.0, 20.0, True)]
        rows += [(1, page, "world", 60.0, 201.0, 90.0, 211.0, 10.0, False), (1, page, "hello wide", 10.0, 200.0, 50.0, 210.0, 10.0, False), (1, page, "the body goes on here", 10.0, 220.0, 90.0, 230.0, 10.0, False)]
    t = spark.createDataFrame(rows, "document_id int, page int, text string, left double, top double, right double, bottom double, font_size double, bold boolean")
    got = spans.heading_levels(spans.without_margins(spans.lines(t), 1000.0)).orderBy("page", "top").collect()
    assert [(r.text, r.level) for r in got if r.page == 2] == [("Title 2", 1), ("hello wide world", None), ("the body goes on here", None)]
    x, y = spans.rotated("left", "top", "100", "200", "90")
    assert t.limit(1).select(x, y).first() == (195.0, 10.0)
    b = t.groupBy("page").agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("b")).where("page = 1").select(F.expr(spans.box_union("b")).alias("u")).first().u
    assert tuple(b) == (10.0, 5.0, 90.0, 998.0)
