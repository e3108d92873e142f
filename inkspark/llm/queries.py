"""Queries over whole tables, one per operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import prepare, table
from .decontaminate import contaminated
from .html_text import extract_pages
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_classes
from .quality import QualityParams, quality_verdicts, with_counts
from .sentencepiece import encode_documents
from .sql import ORACLES
from .token_files import read_token_files, write_token_files
from .url_filter import judge_urls, ruled_urls
from .warc import expect_whole, read_archives, resolved, write_archives


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents state (see :mod:`inkspark.llm.licenses`)."""
    return scan_licenses(table(prepare(spark), sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (see :mod:`inkspark.llm.html_text`)."""
    return extract_pages(table(prepare(spark), sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items (see :mod:`inkspark.llm.decontaminate`)."""
    return contaminated(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url (see :mod:`inkspark.llm.url_filter`)."""
    return judge_urls(table(prepare(spark), sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document (see :mod:`inkspark.llm.ngram_join`)."""
    return ngram_classes(table(prepare(spark), sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding gives the text back (see :mod:`inkspark.llm.sentencepiece`)."""
    return encode_documents(table(prepare(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from packed files (see :mod:`inkspark.llm.token_files`)."""
    return read_token_files(write_token_files(table(prepare(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its cross-site lines (see :mod:`inkspark.llm.line_dedup`)."""
    docs = table(prepare(spark), sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "text", "__removed").withColumnRenamed("__removed", "n_removed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its WARC record (see :mod:`inkspark.llm.warc`)."""
    return resolved(expect_whole(*read_archives(write_archives(table(prepare(spark), sf_dir, "pages")))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of every document (see :mod:`inkspark.llm.quality`)."""
    return quality_verdicts(table(prepare(spark), sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 takes from a url and from its rules, without the trees."""
    return ruled_urls(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "ruled")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op10, without the estimates."""
    return with_counts(table(spark, sf_dir, "documents"), "text", QualityParams(), ["doc_id"]).drop("_lines")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_extraction, op3_benchmark_decontamination, op4_url_filter, op5_ngram_jaccard_join,
        op6_sentencepiece, op7_token_files, op8_line_dedup, op9_warc, op10_quality_rules, url_rules, quality_counts,
    )
}

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]
