"""Queries on lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document with its length in bytes."""
    return S.lines(read(spark, d, "documents"), "text", "doc_id").select(
        "doc_id", F.col("line").cast("long").alias("line"), F.octet_length("line_text").cast("long").alias("n_bytes"), "line_text"
    )


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of a word, ASCII case ignored, with its byte column."""
    rows = S.lines(read(spark, d, "documents"), "text", "doc_id", "lang")
    return S.search(rows, "the", "doc_id", "line", ignore_case=True).select(
        "doc_id", F.col("line").cast("long").alias("line"), F.col("hit").cast("long").alias("hit"), "col"
    )


def search_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits per document."""
    rows = S.lines(read(spark, d, "documents"), "text", "doc_id", "lang")
    return S.search(rows, "the", "doc_id", "lang", ignore_case=True).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n_hits"))


def search_top_documents(spark: SparkSession, d: str) -> DataFrame:
    """The twenty documents with the most hits (a report; ties by id)."""
    return search_counts(spark, d).orderBy(F.desc("n_hits"), "doc_id").limit(20)


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line_text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents"
_PIECES = f"SELECT doc_id, lang, line, string_split({_FOLD.format('line_text')}, 'the') AS p FROM ({_LINES})"
_COUNTS = f"SELECT doc_id, lang, CAST(sum(len(p) - 1) AS BIGINT) AS n_hits FROM ({_PIECES}) GROUP BY doc_id, lang HAVING sum(len(p) - 1) > 0"

QUERIES = {"doc_lines": doc_lines, "search_hits": search_hits, "search_counts": search_counts, "search_top_documents": search_top_documents}
ORACLES = {
    "doc_lines": f"SELECT doc_id, line, CAST(strlen(line_text) AS BIGINT) AS n_bytes, line_text FROM ({_LINES})",
    "search_hits": f"""SELECT doc_id, line, hit, CAST(list_sum(list_transform(p[1:hit + 1], lambda x: strlen(x))) + 3 * hit AS BIGINT) AS col
        FROM (SELECT doc_id, line, p, unnest(range(len(p) - 1)) AS hit FROM ({_PIECES}) WHERE len(p) > 1)""",
    "search_counts": _COUNTS,
    "search_top_documents": f"SELECT * FROM ({_COUNTS}) ORDER BY n_hits DESC, doc_id LIMIT 20",
}
