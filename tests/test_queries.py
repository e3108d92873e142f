"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkspark.functions import cells, labels
from inkspark.operators import documents, search
from inkspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def test_cell_references(spark):
    df = spark.createDataFrame([("$B$7",), ("XFD1048576",), ("XFE1",), ("A0",), ("a1",), (None,)], "r string")
    got = [r[0] for r in df.select(cells.split_cell(F.col("r"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(2, 7), (16384, 1048576), None, None, None, None]


def lineitem_far(spark, folder):
    """A copy of line items whose order keys go on beyond a sheet's last row, and a connection that reads it."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").limit(500)
    far = [rows.withColumn("l_orderkey", (F.col("l_orderkey") % 10 + k).cast("long")) for k in (1, 1_048_570, 9_000_000, 5_000_000_000)]
    far[0].union(far[1]).union(far[2]).union(far[3]).write.parquet(f"{folder}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return c


def test_a1_from_rowcol_beyond_a_sheet(spark, tmp_path):
    con = lineitem_far(spark, tmp_path)
    got = catalog.QUERIES["a1_from_rowcol"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["a1_from_rowcol"]).fetchall()) and all(r["cell"] for r in got)


def test_a1_roundtrip_beyond_a_sheet(spark, tmp_path):
    con = lineitem_far(spark, tmp_path)
    assert [tuple(catalog.QUERIES["a1_roundtrip"](spark, str(tmp_path)).first())] == con.sql(catalog.ORACLES["a1_roundtrip"]).fetchall() == [(2000, 2000)]
    df = spark.createDataFrame([("A1048577",), ("A12345678",)], "r string")
    assert [r[0] for r in df.select(cells.split_cell(F.col("r"))).collect()] == [None, None]
    assert [tuple(r[0]) for r in df.select(cells.split_cell(F.col("r"), None)).collect()] == [(1, 1048577), (1, 12345678)]


def test_search_edges(spark):
    df = spark.createDataFrame([(1, "haha ha"), (2, "éhaé"), (3, ""), (4, None)], "k int, line_text string")
    got = search.search(df, "ha", "k").orderBy("k", "hit").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (1, 1, 2), (1, 2, 5), (2, 0, 2)]
    assert search.search(df, "", "k").count() == 0 and search.search(df, "HA", "k", ignore_case=True).count() == 4


def test_flat_text_keeps_empty_paragraphs(spark):
    rows = [(1, 0, 0, "run", "a", ""), (1, 0, 1, "del", "", "x"), (1, 1, 0, "del", "", "y"), (1, 2, 0, "ins", "b", "")]
    df = spark.createDataFrame(rows, "d int, p int, r int, kind string, t string, dt string")
    view = lambda v: documents.flat_text(df, ["d"], ["p"], ["r"], "kind", "t", "dt", v).first()["text"]
    assert view("accept") == "a\n\nb" and view("reject") == "ax\ny\n"


def test_headers_of_a_section(spark):
    sections = spark.createDataFrame([("a", 0, {"default": "h1"}), ("a", 1, {"first": "h2", "default": "h1"}), ("b", 0, {})], "path string, section_idx int, headers map<string,string>")
    content = spark.createDataFrame([("a", "h1", "one"), ("a", "h2", "two"), ("b", "h1", "else")], "path string, part string, text string")
    got = lambda *args: sorted((r["kind"], r["text"]) for r in documents.side_blocks(sections, content, "headers", *args).collect())
    assert got() == [("default", "one"), ("first", "two")] and got(-1, "first") == [("first", "two")] and got(0) == [("default", "one")]
    with pytest.raises(Exception, match="no section 1 in b"):
        got(1)


def test_first_to_max_and_labels(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((10, 12, 12, 10))], "i int, s int")
    assert documents.first_to_max(df.withColumn("k", F.lit(1)), ["k"], "s", "i", "b").first()["b"] == 12
    row = spark.range(1).select(labels.label(F.lit("r"), F.lit("x"), F.lit(1994)), labels.label(F.lit("a"), F.lit(""), F.lit(28)), labels.label(F.lit(""), F.lit("p"), F.lit(2))).first()
    assert tuple(row) == ("xmcmxciv", "ab", "p")


def test_as_of(spark):
    from inkspark.operators import ranges

    starts = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 20, "c"), (4, 35, "d")], "ord int, start long, name string")
    points = spark.createDataFrame([(k,) for k in (0, 9, 10, 19, 20, 34, 35, 99, 99)], "p long")
    want = [(0, None), (9, None), (10, "a"), (19, "a"), (20, "c"), (34, "c"), (35, "d"), (99, "d"), (99, "d")]
    for parts in (64, 2, 1):
        got = ranges.as_of(points, starts, "p", "start", "ord", ["name"], parts=parts).collect()
        assert sorted(tuple(r) for r in got) == want
    assert ranges.as_of(points, starts.limit(0), "p", "start", "ord", ["name"]).filter("name IS NULL").count() == 9


def test_as_of_where_points_crowd(spark, monkeypatch):
    from inkspark.operators import ranges

    monkeypatch.setattr(ranges, "PART_ROWS", 40)
    begins = sorted({*range(0, 300, 3), 290, 10**12, -7})
    starts = spark.createDataFrame([(k, b, f"s{b}") for k, b in enumerate(begins)], "ord int, start long, name string")
    at = [*range(-20, 20), *range(1000, 1400), 10**12, 10**15, None, -7]
    points = spark.createDataFrame([(k,) for k in at], "p long")
    name = lambda p: None if p is None else next((f"s{b}" for b in reversed(begins) if b <= p), None)
    for parts in (8, 1, 200):
        found = ranges.as_of(points, starts, "p", "start", "ord", ["name"], parts=parts)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((p, name(p))) for p in at)
    tree = catalog.QUERIES["label_asof"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in tree and "hashpartitioning(o_orderkey" not in tree  # few starts: orders stay where they lie


def test_parts_are_counted(spark):
    from inkspark.operators.ranges import _part

    for n in (0, 1, 2, 3, 10, 17):
        cuts = [k * k - 5 for k in range(n)]
        got = spark.range(-8, 300).select("id", _part(F.col("id"), cuts).alias("p")).collect()
        assert [r["p"] for r in got] == [sum(c <= r["id"] for c in cuts) for r in got]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
