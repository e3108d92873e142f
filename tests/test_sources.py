import zipfile

import pytest

from inkspark.operators import layout
from inkspark.sinks import packages, pdf as pdf_sink
from inkspark.sources import cos, docx, pdf, readers, xlsx
from inkspark.sources.package import FormatError

_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(cells: str, extra: str = "", styles: str = "", strings: str = "<si><t>cedar</t></si><si><r><rPr><b/></rPr><t>wind</t></r><r><t>mill</t></r></si>", props: str = "") -> bytes:
    return packages.zip_bytes([
        ("_rels/.rels", f'<Relationships xmlns="x"><Relationship Id="a" Type="{_R}/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode()),
        ("xl/workbook.xml", f'<workbook {_S}>{props}<sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="n" localSheetId="0">One!$A$1</definedName></definedNames></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="r1" Type="{_R}/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="{_R}/sharedStrings" Target="sharedStrings.xml"/></Relationships>'.encode()),
        ("xl/worksheets/s1.xml", f"<worksheet {_S}><sheetData>{cells}</sheetData>{extra}</worksheet>".encode()),
        ("xl/sharedStrings.xml", f"<sst {_S}>{strings}</sst>".encode()),
        ("xl/styles.xml", f"<styleSheet {_S}>{styles}</styleSheet>".encode()),
    ])


CELLS = (
    '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2"><v>7.25</v></c><c t="inlineStr"><is><t>oak</t></is></c><c r="F2" t="b"><v>0</v></c><c r="G2" s="1"><v>45292</v></c></row>'
    '<row r="3"><c r="A3" t="str"><f>B9&amp;C9</f><v>leaf</v></c></row><row r="5"><c r="A5" t="s"><v>0</v></c><c r="B5"><v>19</v></c></row>'
)


def test_xlsx_rows_and_styles():
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs>'
    data = workbook(CELLS, styles=styles)
    assert xlsx.display_rows(data, "one") == [[], ["", "windmill", "7.25", "oak", "", "FALSE", "01.01.2024"], ["leaf"], [], ["cedar", "19"]]
    t = xlsx.parse(data)
    assert t["rich_runs"] == [(1, 0, "wind", True, False, None, None, None), (1, 1, "mill", False, False, None, None, None)]
    assert t["defined_names"][0][1:4] == ("n", "One!$A$1", "One")


def test_xlsx_merges_take_the_first_stored_cell():
    extra = '<mergeCells><mergeCell ref="D6:A4"/><mergeCell ref=""/><mergeCell ref="K7:L9"/></mergeCells>'
    assert [m[1:] for m in xlsx.parse(workbook(CELLS, extra))["merges"]] == [(0, "D6:A4", 4, 6, 1, 4, 5, 1), (2, "K7:L9", 7, 9, 11, 12, 7, 11)]


@pytest.mark.parametrize("ref", ["A0", "a1", "XFE1", "A1048577", "1A", "A01"])
def test_bad_references(ref):
    with pytest.raises(FormatError):
        xlsx.split_ref(ref)


def test_bad_packages():
    with pytest.raises(FormatError, match="OLE"):
        xlsx.parse(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest")
    with pytest.raises(FormatError, match="no sheet"):
        xlsx.parse(workbook(CELLS), "Two")
    with pytest.raises(FormatError, match="shared string"):
        xlsx.display_rows(workbook('<row r="1"><c r="A1" t="s"><v>9</v></c></row>'), "One")
    with pytest.raises(FormatError, match="document.xml"):
        docx.parse(packages.zip_bytes([("a", b"b")]))
    with pytest.raises(FormatError):
        packages.zip_bytes([("../a", b"")])


def test_docx_round_trip():
    b = packages.DocxBuilder("Title", "Author")
    b.paragraph("Hello\tx\ny", "Heading1", "center")
    b.table([["a", "b"], ["c", ""]])
    p = b.paragraph("see ")
    p.runs += [b.hyperlink("link", "http://x"), b.footnote("note"), b.image(b"\x89PNG")]
    b.headers["default"] = [packages.Paragraph([packages.TextRun("head", bold=True)])]
    t = docx.parse(b.to_bytes())
    assert docx.flat_text(b.to_bytes()) == "Hello\tx\ny\na\nb\nc\n\nsee link"
    assert t["documents"][0][:2] == ("Title", "Author") and t["notes"] == [("footnote", 1, "note")]
    assert [h[1] for h in t["hyperlinks"]] == ["http://x"] and t["images"][0][3] == b"\x89PNG" and t["sections"][0][7] == "portrait"
    p.runs.append(packages.TextRun(link="rId77"))
    with pytest.raises(FormatError, match="relationship"):
        b.to_bytes()


def test_docx_revisions():
    body = (
        '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>a</w:t></w:r><w:ins w:id="1"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>old</w:delText></w:r></w:del></w:p>'
        "<w:del><w:p><w:r><w:t>gone</w:t></w:r></w:p></w:del></w:body></w:document>"
    )
    data = packages.zip_bytes([("word/document.xml", body.encode())])
    assert docx.flat_text(data) == "anew" and docx.flat_text(data, "reject") == "aold\ngone"


def test_pdf_text_merge_update_and_recovery():
    data = pdf_sink.flow([("Heading", 18.0), ("Hello world. " * 20, 11.0), ("", 11.0), ("Tail", 11.0)], title="Ünï")
    assert data == pdf_sink.flow([("Heading", 18.0), ("Hello world. " * 20, 11.0), ("", 11.0), ("Tail", 11.0)], title="Ünï")
    t = pdf.parse(data)
    assert t["documents"][0][5] == "Ünï" and t["pages"][0][1:3] == (595.0, 842.0)
    text = pdf.document_text(data)
    assert text.startswith("Heading") and text.endswith("Tail")
    both = pdf_sink.merged([data, pdf_sink.copied([(data, [0, 0])])])
    assert pdf.document_text(both) == "\f".join([text] * 3)
    newer = pdf_sink.updated(data, {3: {"Type": cos.Name("Font"), "Subtype": cos.Name("Type1"), "BaseFont": cos.Name("Courier")}})
    assert newer.startswith(data) and pdf.parse(newer)["runs"][0][6] == "Courier"
    damaged = pdf.parse(data[:-30])
    assert damaged["documents"][0][3] is True and len(damaged["runs"]) == len(t["runs"])
    with pytest.raises(FormatError):
        pdf.parse(b"not a pdf")


def test_pdf_trees():
    name, ref = cos.Name, cos.Ref
    data = pdf_sink.build({
        1: {"Type": name("Catalog"), "Pages": ref(2, 0), "Outlines": ref(5, 0), "PageLabels": {"Nums": [0, {"S": name("r")}, 1, {"S": name("D"), "P": b"A-", "St": 3}]},
            "AcroForm": {"Fields": [ref(8, 0)]}, "Names": {"EmbeddedFiles": {"Names": [b"f", ref(9, 0)]}}},
        2: {"Type": name("Pages"), "Kids": [ref(3, 0), ref(4, 0)], "Count": 2, "MediaBox": [0, 0, 200, 100]},
        3: {"Type": name("Page"), "Parent": ref(2, 0), "Annots": [{"Subtype": name("Link"), "Rect": [5, 6, 1, 2], "A": {"S": name("URI"), "URI": b"http://x"}}]}, 4: {"Type": name("Page"), "Parent": ref(2, 0)},
        5: {"First": ref(6, 0)}, 6: {"Title": b"One", "Next": ref(7, 0), "Dest": [ref(4, 0), name("Fit")]}, 7: {"Title": b"\xfe\xff\x00\xe9"},
        8: {"T": b"box", "FT": name("Btn"), "Ff": 1, "AP": {"N": {"On": None, "Off": None}}},
        9: {"F": b"note.txt", "EF": {"F": ref(10, 0)}}, 10: cos.Stream({}, b"data"),
    }, {"Root": ref(1, 0)})
    t = pdf.parse(data)
    assert [(o[4], o[6]) for o in t["outline"]] == [("One", 1), ("é", -1)]
    assert t["labels"] == [(0, 0, "r", "", 1), (1, 1, "D", "A-", 3)]
    assert t["annots"][0][3:7] == (1.0, 2.0, 5.0, 6.0) and t["annots"][0][9] == "http://x"
    assert t["fields"][0][1:3] == ("box", "checkbox") and t["fields"][0][7:] == (["On"], True)
    assert t["attachments"][0][1:5] == ("f", "note.txt", "", "text/plain") and t["attachments"][0][6] == b"data"


def test_filters():
    assert cos.decoded(b"9jqo^~>", ["A85"], [{}]) == b"Man " and cos.decoded(b"4d616E>", ["AHx"], [{}]) == b"Man"
    assert cos.run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert cos.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert cos.predicted(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])


def test_layout_folds():
    run = lambda t, x, y, s=12.0, w=20.0: layout.Run(t, x, y, s, w)
    lines = layout.fold_lines([run("b", 40, 100), run("a", 10, 100), run("c", 10, 85), run("d", 10, 40)])
    assert [line.text for line in lines] == ["a b", "c", "d"]
    assert [b.text for b in layout.fold_blocks(lines)] == ["a b\nc", "d"]
    rows = [("Name", "Qty", "Price", 200), ("Apples", "12", "1.20", 180), ("Pears", "7", "", 160), ("Figs", "3", "2.50", 120)]
    runs = [run(t, x, y, 14.0 if y == 200 else 11.0, 30) for *cells, y in rows for t, x in zip(cells, (10, 110, 210)) if t]
    runs.insert(runs.index(next(r for r in runs if r.text == "Figs")), run("fresh", 10, 147, 11.0, 30))
    (table,) = layout.find_tables(layout.fold_lines(runs))
    assert table.headers == ["Name", "Qty", "Price"]
    assert table.rows == [["Apples", "12", "1.20"], ["Pears\nfresh", "7", ""], ["Figs", "3", "2.50"]]
    assert layout.body_size([layout.Line([], 0, 0, s, False) for s in (10, 12, 12, 10)]) == 12


def test_readers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(CELLS))
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    good = readers.read_table(spark, str(tmp_path / "a.xlsx"), "xlsx", "cells")
    assert good.filter("cell_type = 'number' OR cell_type = 'unset'").count() == 3
    both = readers.read_table(spark, str(tmp_path), "xlsx", "sheets", mode="PERMISSIVE")
    assert sorted((r["name"], r["_error"] is not None) for r in both.collect() if r["name"]) == [("One", False)]
    assert both.filter("_error IS NOT NULL").count() == 1
    readers.register(spark)
    (tmp_path / "c").mkdir()
    with zipfile.ZipFile(tmp_path / "c" / "z.zip", "w") as z:
        z.writestr("x.txt", "abc")
    got = spark.read.format("inkspark_zip").option("table", "entries").load(str(tmp_path / "c")).select("name", "usize").collect()
    assert [tuple(r) for r in got] == [("x.txt", 3)]
    cells = spark.read.format("inkspark_xlsx").option("table", "cells").load(str(tmp_path / "a.xlsx"))
    assert cells.filter("sheet = 'One'").count() == good.count()


def test_layout_tables_in_spark(spark):
    runs = [("f", 0, i, t, float(x), float(y), 12.0, "F", 30.0, False) for i, (t, x, y) in enumerate([("Alpha", 72, 700), ("beta", 110, 700), ("Gamma", 72, 600)])]
    df = spark.createDataFrame(runs, "path string, page int, run_idx int, text string, x double, y double, size double, font_name string, w double, vert boolean")
    lines = layout.lines_of(df)
    assert [(r["text"], r["block"]) for r in lines.orderBy("line").collect()] == [("Alpha beta", 0), ("Gamma", 1)]
    assert {r["kind"] for r in layout.sheet_of(lines).collect()} == {"paragraph"}


def test_stream_of_documents(spark, tmp_path):
    from inkspark.streaming.arrivals import arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf_sink.flow([("Hi", 12.0)]))
    q = arriving(spark, str(tmp_path / "in"), "pdf", "runs").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["text"] for r in spark.sql("SELECT text FROM arrived").collect()] == ["Hi"]


def test_written_by_the_data_sources(spark, tmp_path):
    readers.register(spark)
    rows = spark.createDataFrame([(f"d{k % 3}.docx", k, f"paragraph {k}") for k in range(30)], "file string, n int, text string")
    ordered = rows.repartition(2, "file").sortWithinPartitions("file", "n")
    ordered.write.format("inkspark_docx").mode("append").save(str(tmp_path / "docs"))
    names = sorted(p.name for p in (tmp_path / "docs").iterdir())
    assert names == ["d0.docx", "d1.docx", "d2.docx"]
    assert docx.flat_text((tmp_path / "docs" / "d1.docx").read_bytes()) == "\n".join(f"paragraph {k}" for k in range(1, 30, 3))
    ordered.selectExpr("replace(file, 'docx', 'pdf') AS file", "n", "text", "9D AS size").write.format("inkspark_pdf").mode("append").save(str(tmp_path / "pdfs"))
    back = spark.read.format("inkspark_pdf").option("table", "runs").load(str(tmp_path / "pdfs"))
    assert back.filter("text LIKE 'paragraph%' OR text = '4'").count() > 0
    entries = spark.createDataFrame([(f"e{k}", bytearray(b"x" * k)) for k in range(9)], "name string, content binary").coalesce(1)
    for mode in ("append", "overwrite"):
        entries.write.format("inkspark_zip").mode(mode).save(str(tmp_path / "zips"))
    got = spark.read.format("inkspark_zip").load(str(tmp_path / "zips"))
    assert sorted((r["name"], r["usize"]) for r in got.collect()) == [(f"e{k}", k) for k in range(9)]
    with pytest.raises(Exception, match="do not stand together"):
        rows.coalesce(1).orderBy("n").coalesce(1).write.format("inkspark_docx").mode("append").save(str(tmp_path / "mixed"))
    assert not [p for p in (tmp_path / "mixed").rglob("*") if p.is_file()] if (tmp_path / "mixed").exists() else True


def test_broken_files_in_the_data_sources(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "a.zip").write_bytes(b"no archive")
    (tmp_path / "b.zip").write_bytes(packages.zip_bytes([("x", b"y")]))
    got = spark.read.format("inkspark_zip").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()
    assert sorted((r["name"] or "", bool(r["_error"])) for r in got) == [("", True), ("x", False)]


def _line(y, size, *cells):
    return layout.Line([layout.Run(t, x, y, size, 30.0) for x, t in cells], cells[0][0], y, size, False)


def test_tables_by_the_rules_of_edges():
    found = layout.find_tables([_line(700, 10, (50, "a"), (200, "1")), _line(680, 10, (50, "b"), (200, "2")), _line(668, 10, (200, "x")), _line(640, 10, (50, "c"))])
    assert [(t.headers, t.rows, t.members) for t in found] == [([], [["a", "1"], ["b", "2\nx"]], {0, 1, 2})]
    assert (found[0].x, found[0].y, found[0].w, found[0].h) == (50, 700, 180, 32)
    headed = layout.find_tables([_line(700, 14, (50, "h"), (200, "k")), *(_line(680 - 20 * k, 10, (50, f"r{k}"), (200, str(k))) for k in range(3))])
    assert headed[0].headers == ["h", "k"] and len(headed[0].rows) == 3
    assert not layout.find_tables([_line(700 - 12 * k, 10, (50, "body text"), (83, "runs on")) for k in range(9)])  # no gutter
    apart = [_line(y, 10, (50, "p"), (200, "q")) for y in (700, 680, 600, 580)]
    assert [len(t.rows) for t in layout.find_tables(apart)] == [2, 2]
    outside = [_line(720, 10, (200, "q"), (300, "r")), *(_line(700 - 20 * k, 10, (50, "p"), (200, "q"), (300, "r")) for k in range(3))]
    assert [len(t.rows) for t in layout.find_tables(outside)] == [3]


def test_dictionary_is_in_order(spark):
    from inkspark.operators import grid

    values = [f"v{k % 700:04d}" for k in range(3000)] + ["", None]
    got = grid.dictionary(spark.createDataFrame([(v,) for v in values], "s string"), "s").orderBy("idx").collect()
    want = [None, *sorted({v for v in values if v is not None})]
    assert [(r["idx"], r["value"]) for r in got] == list(enumerate(want))


def test_pdf_lines_are_measured_once():
    import time

    began = time.process_time()
    assert len(pdf_sink.wrapped("a bc " * 20_000, 10.0, 1e9)) == 1
    assert time.process_time() - began < 5  # the square of the line's length took minutes
    text, size, width = "It is  a test of w\u00e9ry (short) and averyveryverylongword lines " * 20, 9.5, 120.0
    want, line = [], ""
    for word in text.split():
        longer = f"{line} {word}" if line else word
        if line and pdf_sink.text_width(longer, size) > width + 1e-6:
            want.append(line)
            line = word
        else:
            line = longer
    assert pdf_sink.wrapped(text, size, width) == [*want, line]


def test_files_are_dealt_out(spark):
    from inkspark.plans import files

    rows = spark.range(60).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    made = files.as_files(rows, "doc_id", "text", lambda v: v.encode())
    filled = [n for n in made.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(filled) == 60 and len(filled) >= 4


def test_missing_fonts_do_not_lend_their_names():
    from inkspark.sources.cos import Name, Ref, Stream

    body = b"BT /N 1 Tf 1 Tw /N 2 Tf 2 Tw /F1 10 Tf (a) Tj [(b) 5 (c)] TJ (\\(x) Tj <4a4> Tj -3.5 .5 Td (d)Tj/F1 5 Tf(e)Tj %c\n[(f) -2--3 (g)] TJ"
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 4: Stream({}, body),
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Resources": {"Font": {"F1": Ref(5, 0)}}, "Contents": Ref(4, 0)}, 5: {"Type": Name("Font"), "BaseFont": Name("One"), "FirstChar": 97, "Widths": [500, 600.5]},
    }
    runs = pdf.parse(pdf_sink.build(objects, {"Root": Ref(1, 0)}))["runs"]
    assert [(r[2], r[6]) for r in runs] == [(t, "One") for t in ("a", "b", "c", "(x", "J@", "d", "e", "f", "g")]


def test_small_pages_share_batches(spark):
    rows = [(f"f{k % 97}", k % 5, k // 485, f"t{k}", float(k * 37 % 200), 700.0 - k * 13 % 60, 12.0, 20.0, False) for k in range(5000)]
    rows += [(None, 0, 1, "b", 50.0, 5.0, 12.0, 20.0, False), (None, 0, 0, "a", 1.0, 5.0, 12.0, 20.0, False)]
    df = spark.createDataFrame(rows[::-1], "path string, page int, run_idx int, text string, x double, y double, size double, w double, vert boolean")
    found = layout.lines_of(df)
    for d in (found, layout.tables_of(df)):  # a call of Python per page took a millisecond and more
        assert "InPandas" not in d._jdf.queryExecution().toString()
    want = []
    for path, page in {r[:2] for r in rows}:
        runs = [layout.Run(*r[3:]) for r in sorted((r for r in rows if r[:2] == (path, page)), key=lambda r: r[2])]
        n = 0
        for b, block in enumerate(layout.fold_blocks(layout.fold_lines(runs))):
            for line in block.lines:
                want.append((path, page, n, b, line.text, line.x, line.y))
                n += 1
    got = [tuple(r) for r in found.select("path", "page", "line", "block", "text", "x", "y").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and (None, 0, 0, 0, "a b", 1.0, 5.0) in got


def test_docx_text_is_parsed_once(spark):
    from inkspark.plans import files

    flat = files.docx_flat_text(spark, "/root/testdata/sf0.001")
    tree = flat._jdf.queryExecution().executedPlan().toString()
    assert tree.count("MapInArrow") == 2 and "Join" not in tree  # written once and read once
    builder = packages.DocxBuilder("A text")
    for text in ("one", "", "two"):
        builder.paragraph(text)
    builder.blocks[0].runs.append(packages.TextRun("more"))
    got = docx.parse(builder.to_bytes())["paragraph_runs"]
    assert [(r[1], r[2], r[4]) for r in got] == [([0], 0, "one"), ([0], 1, "more"), ([1], None, None), ([2], 0, "two")]
