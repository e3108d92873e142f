"""Document-shaped queries: flat text, revisions, layout, labels, metadata, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import metadata as M
from ..operators import documents as D
from ..operators import layout, lookups, ranges
from .text import read


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def search_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of every line, cut to 120 bytes at a character."""
    from ..operators.search import excerpt, lines

    return lines(read(spark, d, "documents"), "text", "doc_id").select("doc_id", _long("line"), excerpt(F.col("line_text")).alias("excerpt"))


def flat_text_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as the paragraphs of a text."""
    return D.joined_text(read(spark, d, "conversations"), ["conv_id"], ["turn"], "text", "\n")


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 2, "del").when(F.col("role") == "assistant", "ins").otherwise("run")
    return rows.select("conv_id", "turn", kind.alias("kind"), "text")


def flat_text_accept(spark: SparkSession, d: str) -> DataFrame:
    """The same with all revisions accepted."""
    return D.joined_text(D.in_view(_revisions(spark, d), "kind", "text", "text", "accept"), ["conv_id"], ["turn"], "text", "\n")


def revisions_reject(spark: SparkSession, d: str) -> DataFrame:
    """The same with all revisions rejected."""
    return D.joined_text(D.in_view(_revisions(spark, d), "kind", "text", "text", "reject"), ["conv_id"], ["turn"], "text", "\n")


def page_text_join(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages, joined by form feeds; the size of the result in bytes."""
    pages = D.joined_text(read(spark, d, "conversations"), ["conv_id"], ["turn"], "text", "\f")
    return pages.select("conv_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


def _sized_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.search import lines

    rows = lines(read(spark, d, "documents"), "text", "doc_id")
    n = F.octet_length("line_text")
    return rows.withColumn("size", F.when(n < 20, 15.0).when(n < 60, 12.0).when(n < 200, 10.0).otherwise(9.0))


def classify_lines(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of lines by their text and a size that follows from their length."""
    rows = _sized_lines(spark, d)
    return rows.select("doc_id", _long("line"), layout.block_kind(F.col("line_text"), F.col("size"), F.lit(12.0)).alias("kind"))


def body_size_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent size per brand, of equals the one that got there first."""
    return D.first_to_max(read(spark, d, "part"), ["p_brand"], "p_size", "p_partkey", "body")


def block_islands(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a user's events: a gap of six hours or a jump of value begins a new one."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(over)
    jump = F.abs(F.col("value") - F.lag("value").over(over))
    rows = rows.withColumn("gap", gap).withColumn("jump", jump)
    blocks = D.islands(rows, ["user_id"], ["ts", "event_id"], (F.col("gap") > 6 * 3600 * 1_000_000) | (F.col("jump") > 200), "block")
    return blocks.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def word_gap_join(spark: SparkSession, d: str) -> DataFrame:
    """Runs of an order's line, a space where the gap is wide enough."""
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 10.0).alias("x"), (F.col("l_quantity") / 5).alias("w"), "l_returnflag", F.col("l_partkey").alias("k"), "l_extendedprice"
    )
    return lookups.gap_joined(rows, ["l_orderkey"], ["x", "k", "l_extendedprice"], "x", "w", "l_returnflag", 1.5)


def run_byte_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where each turn begins in bytes."""
    return lookups.byte_starts(read(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text").drop("text")


def page_labels_roman(spark: SparkSession, d: str) -> DataFrame:
    """Roman labels of 1 to 3999."""
    return spark.range(1, 4000).select(F.col("id").alias("n"), L.label(F.lit("R"), F.lit("p."), F.col("id")).alias("upper"), L.label(F.lit("r"), F.lit(""), F.col("id")).alias("lower"))


def page_labels_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Letter labels of one to three letters."""
    return spark.range(1, 18279).select(F.col("id").alias("n"), L.label(F.lit("A"), F.lit(""), F.col("id")).alias("upper"))


def label_asof(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, labelled by the range that begins last before them; of equal starts the last listed."""
    starts = read(spark, d, "region").select(
        F.col("r_regionkey").alias("ord"), (F.floor(F.col("r_regionkey") / 2) * 400 + 10).alias("start"), F.col("r_name").alias("prefix"), (F.col("r_regionkey") + 3).alias("first")
    )
    pages = read(spark, d, "orders").select("o_orderkey")
    held = ranges.as_of(pages, starts, "o_orderkey", "start", "ord", ["start", "prefix", "first"])
    number = F.col("o_orderkey") - F.col("start") + F.col("first")
    text = F.when(F.col("start").isNull(), (F.col("o_orderkey") + 1).cast("string")).otherwise(F.concat("prefix", F.lit("-"), number.cast("string")))
    return held.select("o_orderkey", text.alias("label"))


def pdf_date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as PDF writes them, some cut short or wrong, and read back."""
    ts, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    full = F.date_format(ts, "'D:'yyyyMMddHHmmss")
    text = F.when(k == 0, F.concat(full, F.lit("Z"))).when(k == 1, F.concat(full, F.lit("-03'30'"))).when(k == 2, F.substring(full, 1, 8)).when(k == 3, F.concat(full, F.lit("x"))).otherwise(F.substring(full, 3, 99))
    rows = read(spark, d, "orders").select("o_orderkey", M.pdf_date(text).alias("p"))
    kept = lambda c: F.when(F.col("p.ok"), F.col(f"p.{c}").cast("long")).alias(c)
    return rows.select("o_orderkey", F.col("p.ok").alias("ok"), *(kept(c) for c in ("year", "month", "day", "hour", "tz_hour", "tz_minute")))


def mime_guess(spark: SparkSession, d: str) -> DataFrame:
    """Media types of urls, taken as file names."""
    name = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    last = F.element_at(F.split(name, "/"), -1)
    return read(spark, d, "pages").select("page_id", M.media_type(last).alias("media_type"))


def byte_range_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a text without bytes 10 to 19: what a signature over two ranges signs."""
    raw = F.encode("text", "UTF-8")
    signed = F.concat(F.substring(raw, 1, 10), F.substring(raw, F.lit(21), F.octet_length("text")))
    return read(spark, d, "documents").select("doc_id", F.sha2(signed, 256).alias("sha256"))


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages chosen by a list with repeats, in its order."""
    pages = read(spark, d, "pages").select(F.col("page_id").alias("page"), F.md5(F.encode("html", "UTF-8")).alias("md5"))
    wanted = read(spark, d, "events").select(F.col("event_id").alias("at"), F.pmod(F.col("user_id") * 7, F.lit(60)).alias("page"))
    return D.selected_pages(pages, wanted, "page", "at").select("at", "page", "md5")


def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Three documents behind one another, pages numbered through."""
    part = lambda k: read(spark, d, "nation").filter(F.col("n_regionkey") % 3 == k).select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("page"), "n_name")
    return D.merged_pages([part(0), part(1), part(2)], "page", "at").select(F.col("at").cast("long").alias("at"), "n_name")


def outline_paths(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation and customer as an outline with paths."""
    region = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nation = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("title"))
    customer = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("title"))
    return D.tree_paths(spark, region.union(nation).union(customer), "node", "parent", "title").select("node", _long("depth"), "path")


def header_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as sections of their nation's document: all headers of the last section, and footers of the first for first pages."""
    rows = read(spark, d, "customer").withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    part = lambda kind: F.concat(F.lit(kind), F.col("c_custkey"))
    refs = F.create_map(F.lit("first"), part("f"), F.lit("default"), part("d"))
    sections = rows.select(F.col("c_nationkey").cast("string").alias("path"), F.col("n").alias("section_idx"), refs.alias("headers"), refs.alias("footers"))
    content = rows.select(F.col("c_nationkey").cast("string").alias("path"), F.explode(F.array(part("f"), part("d"))).alias("part"), F.col("c_name").alias("text"))
    both = D.side_blocks(sections, content).withColumn("side", F.lit("header")).union(D.side_blocks(sections, content, "footers", 0, "first").withColumn("side", F.lit("footer")))
    return both.select(F.col("path").cast("long").alias("nation"), "side", _long("ord"), "kind", "part", "text")


def numbering_override(spark: SparkSession, d: str) -> DataFrame:
    """Levels of lists: an override takes the place of the base where there is one, the last listed of several."""
    base = read(spark, d, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("base"), F.col("n_nationkey")).alias("base"))
    over = read(spark, d, "supplier").filter("s_nationkey % 2 = 0").select("s_nationkey", "s_suppkey", "s_name")
    return lookups.overridden(base, over, ["n_nationkey"], "s_nationkey", "s_suppkey", "s_name", "level", "base").select("n_nationkey", "level")


def theme_color(spark: SparkSession, d: str) -> DataFrame:
    """Theme colours shaded and tinted."""
    base = F.lpad(F.hex(F.pmod(F.col("p_partkey") * 7919, F.lit(16777216))), 6, "0")
    byte = F.lpad(F.hex(F.col("p_size") * 5), 2, "0")
    shade, tint = F.when(F.col("p_partkey") % 3 == 0, byte).otherwise(""), F.when(F.col("p_partkey") % 3 == 1, byte).otherwise("")
    return read(spark, d, "part").select("p_partkey", M.theme_color(base, shade, tint).alias("color"))


def field_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of form fields by type and flags."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("Tx", "Ch", "Btn", "Sig", "Zz"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", M.field_kind(kind, (F.col("p_size") * 4096).cast("int")).alias("kind"))


def xref_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of all orders of a customer the last, as of all versions of an object."""
    return D.newest(read(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def smallest_free_id(spark: SparkSession, d: str) -> DataFrame:
    """The smallest line number that an order does not use."""
    return D.first_free(read(spark, d, "lineitem"), "l_linenumber", ["l_orderkey"]).select("l_orderkey", _long("free"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents"
_REV = "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'del' WHEN role = 'assistant' THEN 'ins' ELSE 'run' END AS kind, text FROM conversations"
_TEXT = "SELECT conv_id, string_agg(coalesce(text, ''), {sep} ORDER BY turn) AS text FROM {rows} GROUP BY conv_id"
_ROMAN = "['','M','MM','MMM'][n // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]"
_CHANNEL = "printf('%02X', CAST(CASE WHEN k = 0 THEN floor(v * (s / 255.0::DOUBLE) + 0.5) WHEN k = 1 THEN floor(v * (s / 255.0::DOUBLE) + 255.0::DOUBLE * (1.0::DOUBLE - s / 255.0::DOUBLE) + 0.5) ELSE v END AS INT))"

QUERIES = {
    f.__name__: f
    for f in (
        search_excerpt, flat_text_conversations, flat_text_accept, revisions_reject, page_text_join, classify_lines, body_size_mode, block_islands, word_gap_join,
        run_byte_starts, page_labels_roman, page_labels_alpha, label_asof, pdf_date_parse, mime_guess, byte_range_sha256, extract_pages, merge_documents,
        outline_paths, header_blocks, numbering_override, theme_color, field_kind, xref_newest_wins, smallest_free_id,
    )
}
ORACLES = {
    "search_excerpt": f"""SELECT doc_id, line, CASE WHEN strlen(t) <= 120 THEN t ELSE left(t, CAST(list_max(list_filter(range(0, 121), lambda k: strlen(left(t, k)) <= 120)) AS BIGINT)) || '…' END AS excerpt
        FROM ({_LINES})""",
    "flat_text_conversations": _TEXT.format(sep="chr(10)", rows="conversations"),
    "flat_text_accept": _TEXT.format(sep="chr(10)", rows=f"({_REV}) WHERE kind <> 'del'"),
    "revisions_reject": _TEXT.format(sep="chr(10)", rows=f"({_REV}) WHERE kind <> 'ins'"),
    "page_text_join": f"SELECT conv_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM ({_TEXT.format(sep='chr(12)', rows='conversations')})",
    "classify_lines": f"""SELECT doc_id, line, CASE WHEN b = '' THEN 'other'
        WHEN regexp_matches(b, '^([•\\-*–—‣] |[0-9]+[.)] |[A-Za-z]\\. )') THEN 'list'
        WHEN regexp_matches(lower(b), '^(figure[ :]|fig\\. |fig |table[ :]|listing |equation )') AND size <= 12.0 * 1.1 THEN 'caption'
        WHEN size >= 15.0 THEN 'heading' WHEN size >= 12.0 * 0.8 THEN 'paragraph' ELSE 'other' END AS kind
        FROM (SELECT *, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, CASE WHEN strlen(t) < 20 THEN 15.0 WHEN strlen(t) < 60 THEN 12.0 WHEN strlen(t) < 200 THEN 10.0 ELSE 9.0 END AS size FROM ({_LINES}))""",
    "body_size_mode": """SELECT p_brand, arg_min(p_size, idx) AS body FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM
        (SELECT p_brand, p_size, p_partkey AS idx, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part)) WHERE n = top GROUP BY p_brand""",
    "block_islands": """SELECT user_id, block, count(*) AS n, min(event_id) AS first_event FROM
        (SELECT *, CAST(sum(CASE WHEN gap > 21600000000 OR jump > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS block FROM
        (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, abs(value - lag(value) OVER w) AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
        GROUP BY user_id, block""",
    "word_gap_join": """SELECT l_orderkey, string_agg(CASE WHEN x - lx >= 1.5 THEN ' ' ELSE '' END || l_returnflag, '' ORDER BY x, l_partkey, l_extendedprice) AS text FROM
        (SELECT *, lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_extendedprice) AS lx FROM
        (SELECT *, l_linenumber * 10.0::DOUBLE AS x, l_quantity / 5 AS w FROM lineitem)) GROUP BY l_orderkey""",
    "run_byte_starts": "SELECT conv_id, turn, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations",
    "page_labels_roman": f"SELECT n, 'p.' || {_ROMAN} AS upper, lower({_ROMAN}) AS lower FROM range(1, 4000) t(n)",
    "page_labels_alpha": "SELECT n, CASE WHEN n > 702 THEN chr(CAST(65 + (((n - 1) // 26 - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS upper FROM range(1, 18279) t(n)",
    "label_asof": """WITH s AS (SELECT start, arg_max(prefix, ord) AS prefix, arg_max(first, ord) AS first FROM
        (SELECT r_regionkey AS ord, r_regionkey // 2 * 400 + 10 AS start, r_name AS prefix, r_regionkey + 3 AS first FROM region) GROUP BY start)
        SELECT o_orderkey, CASE WHEN start IS NULL THEN CAST(o_orderkey + 1 AS VARCHAR) ELSE prefix || '-' || (o_orderkey - start + first) END AS label
        FROM orders ASOF LEFT JOIN s ON o_orderkey >= start""",
    "pdf_date_parse": """SELECT o_orderkey, k <> 3 AS ok, CASE WHEN k <> 3 THEN year(o_orderdate) END AS year, CASE WHEN k <> 3 THEN month(o_orderdate) END AS month,
        CASE WHEN k = 2 THEN 1 WHEN k <> 3 THEN day(o_orderdate) END AS day, CASE WHEN k = 2 THEN 0 WHEN k <> 3 THEN hour(o_orderdate) END AS hour,
        CASE WHEN k = 1 THEN -3 WHEN k <> 3 THEN 0 END::BIGINT AS tz_hour, CASE WHEN k = 1 THEN -30 WHEN k <> 3 THEN 0 END::BIGINT AS tz_minute FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""",
    "mime_guess": """SELECT page_id, CASE WHEN e IN ('html', 'htm') THEN 'text/html' WHEN e = 'pdf' THEN 'application/pdf' WHEN e = 'txt' THEN 'text/plain' WHEN e = 'xml' THEN 'text/xml'
        WHEN e = 'json' THEN 'application/json' WHEN e = 'png' THEN 'image/png' WHEN e IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN e = 'zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS media_type
        FROM (SELECT page_id, CASE WHEN contains(f, '.') THEN lower(string_split(f, '.')[-1]) ELSE '' END AS e FROM
        (SELECT page_id, string_split(string_split(string_split(url, '#')[1], '?')[1], '/')[-1] AS f FROM pages))""",
    "byte_range_sha256": """SELECT doc_id, sha256(from_hex(substr(h, 1, 20) || substr(h, 41))) AS sha256 FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)""",
    "extract_pages": "SELECT event_id AS at, page_id AS page, md5(html) AS md5 FROM events JOIN pages ON (user_id * 7) % 60 = page_id",
    "merge_documents": "SELECT row_number() OVER (ORDER BY n_regionkey % 3, n_nationkey) - 1 AS at, n_name FROM nation",
    "outline_paths": """SELECT 'r' || r_regionkey AS node, 0::BIGINT AS depth, r_name AS path FROM region UNION ALL
        SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
        SELECT 'c' || c_custkey, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "header_blocks": """WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, min(c_custkey) AS a, max(c_custkey) AS b FROM customer GROUP BY 1)
        SELECT nation, 'header' AS side, k::BIGINT AS ord, CASE k WHEN 0 THEN 'first' ELSE 'default' END AS kind, CASE k WHEN 0 THEN 'f' ELSE 'd' END || b AS part, c_name AS text
        FROM s JOIN customer ON c_custkey = b, range(0, 2) t(k) UNION ALL SELECT nation, 'footer', 0, 'first', 'f' || a, c_name FROM s JOIN customer ON c_custkey = a""",
    "numbering_override": """SELECT n_nationkey, coalesce(s_name, 'base' || n_nationkey) AS level FROM nation LEFT JOIN
        (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY s_nationkey) ON n_nationkey = s_nationkey""",
    "theme_color": f"""SELECT p_partkey, string_agg({_CHANNEL}, '' ORDER BY c) AS color FROM
        (SELECT p_partkey, p_partkey % 3 AS k, p_size * 5 AS s, c, ((p_partkey * 7919) % 16777216) // CAST(pow(256, 2 - c) AS BIGINT) % 256 AS v FROM part, range(0, 3) t(c)) GROUP BY p_partkey""",
    "field_kind": """SELECT p_partkey, CASE k WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN f // 131072 % 2 = 1 THEN 'dropdown' ELSE 'list_box' END
        WHEN 2 THEN CASE WHEN f // 65536 % 2 = 1 THEN 'push_button' WHEN f // 32768 % 2 = 1 THEN 'radio' ELSE 'checkbox' END WHEN 3 THEN 'signature' ELSE 'unknown' END AS kind
        FROM (SELECT p_partkey, p_partkey % 5 AS k, p_size * 4096 AS f FROM part)""",
    "xref_newest_wins": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "smallest_free_id": """SELECT l_orderkey, (SELECT min(n) FROM range(1, 20) t(n) WHERE NOT list_contains(used, n)) AS free FROM (SELECT l_orderkey, list(DISTINCT CAST(l_linenumber AS BIGINT)) AS used FROM lineitem GROUP BY l_orderkey)""",
}
