import struct
import zlib

import numpy as np
import pytest

from inkspark.functions import colors
from inkspark.operators import sheet
from inkspark.sinks import images
from inkspark.sources.package import FormatError

from .test_sources import workbook

CELLS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>44927</v></c><c r="C1"><f t="shared" si="0" ref="C1:C3">A1+$B$1</f><v>1</v></c></row>'
    '<row r="2"><c r="A2" t="b"><v>1</v></c><c r="C2"><f t="shared" si="0"/><v>2</v></c><c r="D2"><f>SUM(A1:A2)</f></c></row><row r="3"><c r="C3"><f t="shared" si="9"/></c></row>'
)
EXTRA = '<mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="B1:C3"/></mergeCells><cols><col min="1" max="3" width="9"/><col min="2" max="2" width="20"/></cols>'
STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts><font><b/><name val="X"/></font></fonts><cellXfs><xf numFmtId="0" fontId="7"/><xf numFmtId="164" fontId="0"/></cellXfs>'


def test_sheet_operators(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook(CELLS, EXTRA, STYLES))
    t = sheet.workbook(spark, str(tmp_path / "w.xlsx"))
    cells = sheet.cell_texts(t["cells"], t["shared_strings"])
    shown = {(r["row"], r["col"]): r["shown"] for r in sheet.display(cells, t["xfs"], t["num_fmts"], t["sheets"]).collect()}
    assert shown[1, 1] == "cedar" and shown[1, 2] == "2023-01-01" and shown[2, 1] == "TRUE" and shown[1, 3] == "1"
    anchors = {(r["row"], r["col"]): (r["anchor_row"], r["anchor_col"]) for r in sheet.merge_anchors(cells, t["merges"]).collect()}
    assert anchors[1, 2] == (1, 1) and anchors[2, 3] == (1, 3) and anchors[2, 4] == (None, None)
    columns = spark.createDataFrame([(cells.first()["path"], "One", k) for k in (1, 2, 3, 4)], "path string, sheet string, col int")
    assert {r["col"]: r["width"] for r in sheet.column_widths(columns, t["cols"]).collect()} == {1: 9.0, 2: 20.0, 3: 9.0, 4: -1.0}
    formulas = {(r["row"], r["col"]): r["formula"] for r in sheet.formulas(t["cells"]).collect()}
    assert formulas == {(1, 3): "A1+$B$1", (2, 3): "A2+$B$1", (2, 4): "SUM(A1:A2)", (3, 3): ""}
    styled = {(r["row"], r["col"]): (r["font_name"], r["bold"]) for r in sheet.styles(cells, t["xfs"], t["fonts"], t["fills"]).collect()}
    assert styled[1, 2] == ("X", True) and styled[1, 1] == (None, None)


def test_colors_and_pixels():
    assert colors.tinted("8A2F6B", 0) == "8A2F6B" and colors.tinted("000000", 0.5) == "808080" and colors.tinted("FFFFFF", -0.25) == "BFBFBF"
    one = colors.samples(bytes([0b10110000, 0b01000000]), 4, 2, 1, 1)
    assert one[..., 0].tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]] and colors.to_rgb(one, "DeviceGray", 1)[0, 0].tolist() == [255] * 3
    assert colors.to_rgb(np.array([[[0, 255, 0, 0]]], np.uint8), "DeviceCMYK").tolist() == [[[255, 0, 255]]]
    assert colors.to_rgb(np.array([[[1]]], np.uint8), "Indexed", palette=bytes([1, 2, 3, 4, 5, 6])).tolist() == [[[4, 5, 6]]]
    assert colors.downscaled(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2)[..., 0].tolist() == [[2, 4], [10, 12]]


def test_image_files():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    raw = images.encoded(pixels, "a.PNG")
    assert zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8]) == b"".join(b"\0" + r.tobytes() for r in pixels)
    b = images.encoded(pixels, "a.bmp")
    assert struct.unpack_from("<I", b, 2)[0] == len(b) and b[54:57] == bytes(pixels[1, 0, ::-1])
    assert images.encoded(pixels, "a.tif")[8:26] == pixels.tobytes()
    for bad in ("a.gif", "a", "a.webp"):
        with pytest.raises(FormatError):
            images.encoded(pixels, bad)
