import io
import struct
import zipfile
import zlib

import pytest

from ombra.sources import files, msg, pdf


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_rels_", "_rels/"), xml)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Primo</w:t><w:tab/><w:t>è</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Ultimo</w:t></w:r></w:p></w:body></w:document>"})
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
ODT = zipped({"content.xml": f"<office:document-content {O}><office:body><text:h>Titolo</text:h><text:p>uno <text:span>due</text:span><text:s text:c='2'/>tre</text:p><table:table><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell><table:table-cell><text:p>y</text:p></table:table-cell></table:table-row></table:table></office:body></office:document-content>"})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Uno" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>nome</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><f>1+1</f><v>2</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
})
EML = b"From: a@b.it\r\nTo: c@d.it\r\nSubject: =?utf-8?q?perch=C3=A9?=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>ciao</p><script>x</script>"
FILES = {
    "a.txt": ("è vero\n".encode(), "è vero\n"),
    "b.TXT": ("perché €".encode("cp1252"), "perché €"),
    "c.md": (b"# t", "# t"),
    "d.csv": (b"a;b\n1;2\n", "a, b\n1, 2\n"),
    "e.html": (b"<p>uno</p><style>x</style><p>due   tre</p>", "uno\ndue tre"),
    "f.eml": (EML, "From: a@b.it\nTo: c@d.it\nSubject: perché\n\nciao"),
    "g.rtf": (b"{\\rtf1{\\fonttbl{\\f0 Arial;}}uno \\'e8\\par due\\u8364 ?}", "uno è\ndue€"),
    "h.docx": (DOCX, "Primo\tè\nUltimo\na\tb"),
    "i.odt": (ODT, "uno due  tre\nx\ny\nTitolo\nx\ty"),
    "j.xlsx": (XLSX, "# Foglio: Uno\nnome, 2\nin"),
}
BROKEN = {"k.docx": b"no zip", "l.txt": b"\x00\x01\x02\x03abc", "m.xyz": b"x", "n.pdf": b"%PDF", "o.rtf": b"plain", "p.xlsx": DOCX, "q.msg": b"x"}


def test_files_of_all_kinds(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    for name, data in BROKEN.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.name: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert len(rows) == len(FILES) + len(BROKEN)
    for name, (_, text) in FILES.items():
        assert (rows[name].text, rows[name].error) == (text, None), name
    for name in BROKEN:
        assert rows[name].text is None and rows[name].error, name


def test_a_reader_from_outside():
    assert files.load("x.pdf", b"%PDF", {"pdf": lambda b: "testo"}) == "testo"
    with pytest.raises(files.DocumentError, match="over"):
        files.load("x.txt", b"x" * (files.LARGEST + 1))


def test_scanned_pages(spark):
    rows = [("a", 1, "x", 0.1, None), ("a", 2, "", 0.9, "recognised text of a page"), ("a", 3, "", 0.0, None), ("b", 1, "t" * 700, 0.9, None), ("b", 2, "t" * 100, 0.9, None), ("b", 3, "t" * 100, 0.2, None), ("c", 1, None, None, None)]
    pages = spark.createDataFrame(rows, "path string, page int, text string, image_cover double, recognised_text string")
    todo = {(r.path, r.page) for r in files.pages_to_recognise(pages).where("recognise").collect()}
    assert todo == {("a", 1), ("a", 2), ("a", 3), ("b", 2), ("c", 1)}
    whole = {r.path: r for r in files.joined_pages(pages).collect()}
    assert whole["a"].text == "x\nrecognised text of a page\n" and whole["a"].recognised == [2]
    assert whole["c"].text is None and whole["c"].error


def test_book_and_dictionaries(spark, tmp_path):
    assert files.book_rows("testo;tipo\nFalco;progetto\nAquila;\n;x\n".encode()) == ([("Falco", "PROGETTO"), ("Aquila", "ALTRO")], 1)
    (tmp_path / "names.tsv").write_text("# nomi\nMario\t0\nRosa\t1\n\n", encoding="utf-8")
    assert {r.token: r.ambiguous for r in files.read_dictionary(spark, str(tmp_path / "names.tsv")).collect()} == {"mario": False, "rosa": True}
    (tmp_path / "words.txt").write_text("Casa\nx1\nè\n", encoding="utf-8")
    assert {r.word for r in files.read_words(spark, str(tmp_path / "words.txt")).collect()} == {"casa", "è"}


def test_dictionaries_of_tables(spark, monkeypatch):
    tokens = spark.createDataFrame([("Mario", False), ("Rosa", True)], "token string, ambiguous boolean")
    words = spark.createDataFrame([("Casa",)], "word string")
    known = files.dictionaries(tokens, tokens.limit(0), words, municipalities=words)
    assert (known.names, known.ambiguous_names, known.surnames, known.vocabulary, known.wide_vocabulary, known.municipalities) == ({"mario", "rosa"}, {"rosa"}, set(), {"casa"}, set(), {"casa"})
    monkeypatch.setattr(files, "MOST_WORDS", 1)
    with pytest.raises(ValueError, match="over 1"):
        files.dictionaries(tokens, tokens, words)


def pdf_file(objects, packed=()):
    """A file of numbered objects, those in ``packed`` inside an object stream."""
    held = b" ".join(b"%d %d" % (n, sum(len(objects[m]) + 1 for m in packed[:i])) for i, n in enumerate(packed))
    body = held + b"\n" + b" ".join(objects[n] for n in packed)
    plain = {n: o for n, o in objects.items() if n not in packed}
    if packed:
        deflated = zlib.compress(body)
        plain[90] = b"<</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n" % (len(packed), len(held) + 1, len(deflated)) + deflated + b"\nendstream"
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, o) for n, o in plain.items()) + b"\ntrailer <</Root 1 0 R>>"


def stream(data, head=b""):
    deflated = zlib.compress(data)
    return b"<<%s /Filter /FlateDecode /Length %d>>\nstream\r\n" % (head, len(deflated)) + deflated + b"\r\nendstream"


MAP = b"1 beginbfchar <01> <00480061> endbfchar 1 beginbfrange <02> <04> <0041> endbfrange 1 beginbfrange <05> <06> [<00E8> <D83CDF38>] endbfrange"
PDF_OBJECTS = {
    1: b"<</Type /Catalog /Pages 2 0 R>>",
    2: b"<</Type /Pages /Kids [7 0 R 3 0 R] /Count 2 /MediaBox [0 0 100 200] /Resources <</Font <</F1 5 0 R /F2 6 0 R>> /XObject <</I 8 0 R /X 9 0 R>>>>>>",
    3: b"<</Type /Page /Parent 2 0 R /Contents [4 0 R 10 0 R]>>",
    4: stream(b"BT /F1 10 Tf 1 0 0 1 10 180 Tm [(Pri) -50 (mo) -400 (rigo\\051 \\350)] TJ T* 0 -12 Td (sec\\\nondo \\(due\\)) Tj"),
    5: b"<</Type /Font /Subtype /Type1>>",
    6: b"<</Type /Font /Subtype /Type0 /ToUnicode 11 0 R>>",
    7: b"<</Type /Page /Parent 2 0 R /Contents 12 0 R>>",
    8: stream(b"xx", b"/Subtype /Image"),
    9: stream(b"q 50 0 0 100 0 0 cm /I Do Q BT /F1 9 Tf (dal modulo) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 0 0]"),
    10: stream(b"40 0 Td <746572 7a6f> ' ET"),
    11: stream(MAP),
    12: stream(b"q 50 0 0 100 0 0 cm /I Do Q BT /F2 9 Tf 5 5 Td <0102030405 06> Tj 0 -20 Td ET /X Do"),
}


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 5, 6, 7)])
def test_pdf_pages(packed):
    first, second = pdf.pages(pdf_file(PDF_OBJECTS, packed))
    assert first == ("HaABCè🌸\ndal modulo", 0.5)
    assert second[0] == "Primo rigo) è\nsecondo (due)\nterzo" or second[0] == "Primo rigo) è\nsecondo (due) terzo"
    assert second[1] == 0.0
    with pytest.raises(ValueError):
        pdf.pages(b"x")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pages(pdf_file(PDF_OBJECTS).replace(b"/Root 1 0 R", b"/Encrypt 9 0 R /Root 1 0 R"))


def test_pdf_files_as_pages(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf_file(PDF_OBJECTS))
    (tmp_path / "b.pdf").write_bytes(b"%PDF nothing")
    (tmp_path / "c.pdf").write_bytes(b"broken")
    rows = files.pdf_pages(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.page or 0, r.image_cover) for r in rows if not r.error) == [("a.PDF", 1, 0.5), ("a.PDF", 2, 0.0)]
    assert [r.path[-5:] for r in rows if r.error] == ["c.pdf"]


def test_scans_go_through_a_reader(spark, tmp_path):
    blank = dict(PDF_OBJECTS) | {12: stream(b"q 100 0 0 200 0 0 cm /I Do Q"), 4: stream(b"q Q"), 10: stream(b"q Q")}
    (tmp_path / "scan.pdf").write_bytes(pdf_file(blank))
    (tmp_path / "text.pdf").write_bytes(pdf_file(PDF_OBJECTS))
    (tmp_path / "bad.pdf").write_bytes(b"broken")

    def reader(data, page):
        if page == 2:
            raise RuntimeError("unreadable")
        return f"pagina {page} riletta di {len(data) > 100}"

    rows = {r.path.rpartition("/")[2]: r for r in files.read_pdfs(spark, str(tmp_path), reader).collect()}
    assert (rows["scan.pdf"].text, rows["scan.pdf"].recognised) == ("pagina 1 riletta di True\n", [1])
    assert rows["text.pdf"].text.startswith("HaABC") and rows["text.pdf"].recognised == [] and rows["bad.pdf"].error
    plain = {r.path.rpartition("/")[2]: r.error for r in files.read_pdfs(spark, str(tmp_path)).collect()}
    assert plain["scan.pdf"] and plain["bad.pdf"] and plain["text.pdf"] is None


def compound(streams):
    """A compound file with its streams in whole sectors and no short ones."""
    names = list(streams)
    sectors, starts = [], []
    for data in streams.values():
        starts.append(2 + len(sectors))
        sectors += [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(1, len(data)), 512)]
    last_dir = 2 + len(sectors)
    entries = [("Root Entry", 5, 1, 0xFFFFFFFE, 0)] + [(n, 2, 0xFFFFFFFF, starts[i], len(streams[n])) for i, n in enumerate(names)]
    directory = b""
    for i, (name, kind, child, start, size) in enumerate(entries):
        raw = name.encode("utf-16-le") + b"\0\0"
        right = i + 1 if 0 < i < len(entries) - 1 else 0xFFFFFFFF
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = directory.ljust(-(-len(directory) // 512) * 512, b"\0")
    dirs = [directory[i : i + 512] for i in range(0, len(directory), 512)]
    table = [0xFFFFFFFD, 0xFFFFFFFE]
    for data in streams.values():
        n = max(1, -(-len(data) // 512))
        table += [len(table) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
    table += [len(table) + k + 1 for k in range(len(dirs) - 1)] + [0xFFFFFFFE]
    head = msg.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, last_dir, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    head = head[:44] + struct.pack("<I", 1) + struct.pack("<IIIIIII", last_dir, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head = (head + struct.pack("<I", 0) + b"\xff" * 432).ljust(512, b"\xff")
    return head + struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff") + bytes(512) + b"".join(sectors) + b"".join(dirs)


def test_outlook_mail():
    wide = lambda t: t.encode("utf-16-le")
    data = compound({"__substg1.0_0C1F001F": wide("a@b.it"), "__substg1.0_0E04001F": wide("c@d.it"), "__substg1.0_0037001F": wide("perché\0"), "__substg1.0_1000001F": wide("corpo " * 300), "__substg1.0_007D001E": b"X: y\r\nDate: Mon, 1 Jan 2024\r\n"})
    assert files.load("x.msg", data) == "From: a@b.it\nTo: c@d.it\nSubject: perché\nDate: Mon, 1 Jan 2024\n\n" + "corpo " * 300
    html = compound({"__substg1.0_0C1A001F": wide("Mario"), "__substg1.0_10130102": "<p>è <b>qui</b></p>".encode()})
    assert files.load("x.msg", html) == "From: Mario\n\nè \nqui"
