"""Operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkspark.llm import decontaminate, licenses, line_dedup, ngram_join, quality
from inkspark.llm._kernels import shingle_sets
from inkspark.llm._spark import join_spread
from inkspark.llm.queries import QUERIES
from inkspark.llm.sql import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text, fold=True):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if fold else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies():
    """A base and copies around it that are less alike among themselves, chains, exact copies and short texts."""
    base = [f"w{i}" for i in range(200)]
    texts = [(0, " ".join(base)), (1, " ".join(base).upper().replace("W", "w"))]
    for k in range(2, 30):
        other = list(base)
        for j in range(4):
            other[(k * 7 + j * 41) % 200] = f"x{k}_{j}"
        texts.append((k, " ".join(other)))
    chain = list(base)
    for k in range(30, 40):
        chain = chain[6:] + [f"c{k}_{j}" for j in range(6)]
        texts.append((k, "\n".join(chain)))
    texts += [(40, "one two"), (41, "ONE  two"), (42, "one two three"), (43, ""), (44, None), (45, " \n\t"), (46, "a b c d e"), (47, "a b c d e f")]
    return texts


def test_ngram_join_against_brute_force(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts] + [(0, texts[0][1], "again")], "doc_id long, text string, node string")
    got = ngram_join.ngram_classes(df).collect()
    assert len(got) == len(texts) + 1
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_with_frequent_shingles_only(spark):
    """Entries by aggregation: every shingle is frequent.  Of each component the smallest id stays."""
    params = ngram_join.JoinParams(frequent_from=2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    df = docs.union(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    want = brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"] for r in ngram_join.keep_one(df, params=params).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.keep_one(docs).count() == 0
    assert quality.quality_filter(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0 and licenses.scan_licenses(docs).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.decontaminated(docs, bench).count() == 0


def test_kernel_counts_shingles():
    import pyarrow as pa

    texts = ["The cat  sat\non the mat", None, "", "a b", "A B C D E", "a b c d e", "é ü ñ ö ß z", "x" * 3_000_000 + " y"]
    assert [len(s) for _, s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def base_counts(text):
    w = words(text, fold=False)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(spark):
    texts = [None, "", " \n", "a b c a b c", "a b c d a b c", "x x x x x", "line\nline\n \n \nline ", "p|q <r> # $ % & *", "\t lead and trail \r\n", "é ü\x0bö", "a\x1cb c", "w " * 300]
    df = spark.createDataFrame([(i, t, None, None, 0, 5) for i, t in enumerate(texts)], DOCS + ", n_words int")
    df = df.union(spark.read.parquet(f"{SF}/documents.parquet").limit(60).select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars", F.lit(5)))
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in quality.quality_verdicts(df).collect():
        want = base_counts(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, rows[r["doc_id"]][:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("distance", F.lit("clash"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    good = [r for i, r in got.items() if labels.get(i) == 1 and not r["base_failed"]]
    bad = [r for i, r in got.items() if labels.get(i) == 0]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_quality_filter_keeps_columns_and_drops_twins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").withColumn("distance", F.lit("clash"))
    docs = docs.union(docs.filter("doc_id = 3").withColumn("text", F.lit("short twin")))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and kept.filter("doc_id = 3").count() == 0


def test_quality_judges_every_row_of_small_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IN ('en', 'de')")
    docs = docs.withColumn("source", F.when(F.col("lang") == "en", "big").otherwise(F.col("source")))  # and few German rows
    junk = " ".join(f"w{i} #$%|<>&*#$%|<>" for i in range(200))
    alone = spark.createDataFrame([(10**6, junk, "en", "left over", 0), (10**6 + 1, junk, None, None, 0)], DOCS)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs.union(alone)).collect()}
    assert all((r["distance"] is None) == r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in got if i >= 10**6)
    assert sum(r["kept"] for r in got.values()) >= 0.8 * sum(not r["base_failed"] for r in got.values())


def test_estimates_against_brute_force(spark):
    """One group without a parent: the estimate has no greater determinant than numpy's from many random starts, and distances
    are those of its own subset."""
    import numpy as np

    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([6000, 1700, 60, 100, 200], np.diag([700, 60, 50, 300, 250.0]) ** 2 + 2000, 300)
    x = np.rint(np.concatenate([good, rng.normal([9000, 1500, 700, 900, 900], 100, (60, 5))])).astype(int)
    stats = spark.createDataFrame([("g", *map(int, row)) for row in x], "g string, " + ", ".join(f"{n} long" for n in quality._NAMES))
    none = {"weight": F.lit(0.0), "p_centre": F.array(*[F.lit(0.0)] * 5), "p_second": F.array(*[F.lit(0.0)] * 15), "p_middle": F.lit(0.0), "p_spread": F.lit(0.0)}
    groups = spark.createDataFrame([("g", len(x))], "g string, rows long").withColumns(none)
    got = quality.mcd(stats, groups, quality.QualityParams()).first()
    added = np.diag([(d * quality._UNIT) ** 2 for d in quality.STATISTICS.values()])

    def fit(rows):
        return rows.mean(0), np.cov(rows.T, bias=True) + added

    def far(centre, scatter):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)

    best = None
    for _ in range(60):
        rows = x[rng.choice(len(x), 30, replace=False)]
        for _ in range(20):
            centre, scatter = fit(rows)
            d = far(centre, scatter)
            rows = x[np.argsort(d)[: int(0.75 * len(x))]]
        value = np.linalg.slogdet(fit(rows)[1])[1]
        if best is None or value < best[0]:
            best = (value, *fit(rows))
    lower = np.array(got["inverse"])
    inverse = np.zeros((5, 5))
    for (i, j), v in zip(quality._PAIRS, lower, strict=True):
        inverse[i, j] = inverse[j, i] = v if i == j else v / 2
    assert -np.linalg.slogdet(inverse)[1] <= best[0] + 0.05
    d = far(np.array(got["centre"]), np.linalg.inv(inverse))
    assert d[300:].min() > d[:300].max() and abs(np.log(np.median(d)) - got["middle"]) < 0.05


def test_line_dedup_against_brute_force(spark):
    shared, near, rare = "this line stands on many sites", "this line stands on two sites", "short line"
    rows = [(i, f"{shared}\nown words number {i} are here\n{rare}" + (f"\n {near} " if i < 2 else ""), "en", f"s{i}", i) for i in range(6)]
    rows += [(10, shared, "en", "s0", 0), (10, shared, "en", "s0", 0), (11, None, "en", None, 0), (12, "", "en", None, 0), (13, f"x\n  {shared}\t\ny", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"], r["text"], r["__removed"]) for r in line_dedup.dedup_lines(df).collect() if r["text"] is not None)
    want = []
    for i, text, *_ in rows:
        if text is None:
            continue
        gone = [k for k, line in enumerate(text.split("\n")) if line.strip() == shared and (i, k) != (0, 0)]
        want.append((i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone)))
    assert got == sorted(want)


@pytest.mark.parametrize(("sites", "min_sites", "spread"), [(3, 3, True), (2, 3, False), (5, 5, True), (4, 5, False)])
def test_line_dedup_thresholds_are_exact(spark, sites, min_sites, spread):
    df = spark.createDataFrame([(i, "one two three four five", "en", f"s{i % sites}", 0) for i in range(40)], DOCS)
    got = line_dedup.dedup_lines(df, params=line_dedup.LineDedupParams(min_sites=min_sites))
    assert got.agg(F.sum("__removed")).first()[0] == (39 if spread else 0)


@pytest.mark.parametrize(("line", "sites", "spread"), [("All rights reserved.", 7, True), ("All rights reserved.", 6, False), ("four words on sites", 5, True), ("four words on sites", 4, False), ("}", 11, True), ("}", 10, False)])
def test_line_dedup_asks_more_sites_of_short_lines(spark, line, sites, spread):
    df = spark.createDataFrame([(i, f"own {i}\n \n {line} ", "en", f"s{i % sites}", 0) for i in range(40)], DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: f"own {i}\n " + (f"\n {line} " if i == 0 or not spread else "") for i in range(40)}


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r["item_id"], words(r["text"])) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        w = words(r["text"])
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        held = set(grams)
        for item, iw in items:
            own = Counter(tuple(iw[i : i + 5]) for i in range(len(iw) - 4))
            if not held & own.keys():
                continue
            width = len(iw) - 4
            best = max(sum((Counter(grams[k : k + width]) & own).values()) for k in range(max(1, len(grams) - width + 1)))
            if best / own.total() >= 0.8:
                want[r["doc_id"], item] = best / own.total()
    assert got.keys() == want.keys() and want
    clean = {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()}
    assert clean == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(20))
    changed = item.replace("q10", "zz")
    rows = [(1, f"lead words {item} tail"), (2, f"lead {changed} tail"), (3, None), (4, ""), (5, "q1 q2 q3"), (1, f"lead words {item} tail"), (6, item.upper()), (7, "tiny one")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny one"), (5, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], round(r["similarity"], 3)) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(1, 1, 1.0), (1, 5, 1.0), (6, 1, 1.0), (6, 5, 1.0), (7, 4, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()) == [2, 3, 4, 5]
    blocks = decontaminate.contaminated(df, bench, params=decontaminate.DecontaminateParams(block_bytes=40))
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == [g[:2] for g in got]


def test_decontamination_by_items_without_id(spark):
    item = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"lead {item} tail"), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()] == [(1, None)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()] == [2]


def test_licenses_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}
    want = set()
    tokens = lambda t: [w for w in re.sub(r"[^\w]+|_", " ", t.lower()).split() if w]
    for r in docs.collect():
        w = tokens(r["text"])
        held = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                tw = tokens(t)
                own = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
                if len(own & held) >= 0.8 * len(own):
                    want.add((r["doc_id"], name))
    assert got == want and want


def test_license_edges(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [(1, "x " * 100 + mit.lower().replace(",", " ,") + " y" * 50), (2, None), (3, ""), (4, "MIT"), (5, mit[: len(mit) // 2]), (6, f"{mit}\n{mit}"), (7, "word " * 60_000 + mit)]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, license string, h5 int")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {(1, "MIT"), (6, "MIT"), (7, "MIT")}


def test_templates_of_any_length(spark):
    long = " ".join(f"term{i % 700}x{i}" for i in range(2500))
    templates = {"long": [long], "two": ["MIT License"], "one": ["Copyleft"], "none": ["..."]}
    rows = [(1, "lead " * 33 + long + " tail" * 9), (2, "under the (MIT) license here"), (3, "a copyleft b copyleft"), (4, "MIT and other license"), (5, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["containment"], r["n_windows"]) for r in licenses.scan_licenses(df, templates=templates).collect()}
    assert got.keys() == {(1, "long"), (2, "two"), (3, "one")} and got[1, "long"][0] == 1.0 and got[3, "one"] == (1.0, 2)


def test_recall_on_edited_notices(spark):
    """Words changed so that 80 to 95 per cent of the shingles are left."""
    import random

    rng = random.Random(4)
    rows, want = [], set()
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            own = re.findall("[a-z0-9]+", text.lower())
            for _ in range(12):
                edited = list(own)
                while len(own) > 25 and rng.random() < 0.6:
                    edited[rng.randrange(len(edited))] = f"zz{rng.randrange(99)}"
                held = {tuple(edited[i : i + 5]) for i in range(len(edited) - 4)}
                whole = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
                if len(held & whole) >= 0.8 * len(whole):
                    want.add((len(rows), name))
                rows.append((len(rows), " ".join([f"f{rng.randrange(999)}" for _ in range(rng.randrange(60))] + edited + [f"f{rng.randrange(999)}" for _ in range(rng.randrange(60))])))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.99 * len(want) and len(want) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "pages"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(columns)).fetchall())


def test_hot_lines_and_entries_are_met_by_broadcast(spark):
    """Keys with a great share of the rows, and the same result as without."""
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 7, id) AS key", "id")
    small = rows.groupBy("key").count()
    got = join_spread(rows, small, ["key"], "count", 5000)
    assert got.count() == 5000 and "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_null_ids_and_clashing_names_in_the_join(spark):
    rows = [(None, "a b c d e f g", 1, 2), (None, "a b c d e f g", 1, 2), (3, "A b c d e f g", 1, 2), (4, "z " * 200_000, 1, 2), (5, "z " * 200_000, 1, 2)]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string, entry int, gid int")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == [(-1, 3), (-1, 3), (3, 3), (4, 1), (5, 1)]
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
