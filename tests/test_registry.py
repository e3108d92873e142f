from inkspark.functions import registry
from inkspark.sinks import packages, pdf


def test_sql_functions(spark):
    registry.register(spark)
    row = spark.sql("SELECT ink_display('1234.5', '#,##0.00') a, ink_formula('=SUM( A1 , B2 )') b, ink_shift_formula('A1+$B$2', 1, 1) c, ink_text_string(X'FEFF00E9') d, ink_display(NULL, '0') e").first()
    assert tuple(row) == ("1,234.50", "SUM(A1,B2)", "B2+$B$2", "é", None)
    builder = packages.DocxBuilder()
    builder.paragraph("Hello")
    data = [(1, packages.zip_bytes([("a.txt", b"abc")]), builder.to_bytes(), pdf.flow([("Hi there", 12.0)])), (2, None, None, None)]
    spark.createDataFrame(data, "k int, z binary, d binary, p binary").createOrReplaceTempView("files")
    assert [tuple(r) for r in spark.sql("SELECT k, e.name, e.usize FROM files, LATERAL ink_zip_entries(z) e").collect()] == [(1, "a.txt", 3)]
    assert [tuple(r) for r in spark.sql("SELECT ink_docx_text(d), ink_pdf_text(p) FROM files ORDER BY k").collect()] == [("Hello", "Hi there"), (None, None)]
    assert [r["text"] for r in spark.sql("SELECT r.text FROM files, LATERAL ink_pdf_runs(p) r").collect()] == ["Hi there"]
