"""Lines of texts and substring search, as relations.

A text's lines are ``split`` on the line feed.  Search finds non-overlapping hits (a hit ends before the next begins),
folds only A-Z when asked to ignore case, and counts columns in UTF-8 bytes.  An empty needle has no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row per line: the kept columns, ``line`` (from 0) and ``line_text``."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "line_text"))


def search(lines_df: DataFrame, needle: str, *keep: str, ignore_case: bool = False, text: str = "line_text") -> DataFrame:
    """One row per hit: the kept columns, ``hit`` (from 0) and ``col`` (byte offset in the line).

    The text between hits is what ``split`` leaves, so the offset of hit ``k`` is the bytes of the pieces up to ``k`` plus
    ``k`` needles; both come from one fold over the pieces, without a shuffle.
    """
    hay = fold_ascii(F.col(text)) if ignore_case else F.col(text)
    want = needle.translate(str.maketrans(_UPPER, _LOWER)) if ignore_case else needle
    if not want:
        return lines_df.select(*keep, F.lit(0).alias("hit"), F.lit(0).cast("long").alias("col")).limit(0)
    width = len(want.encode())
    pieces = F.split(hay, _quoted(want), -1)
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct(
            F.concat(a["at"], F.array(a["end"] + F.octet_length(p))).alias("at"),
            (a["end"] + F.octet_length(p) + width).alias("end"),
        ),
        lambda a: a["at"],
    )
    return lines_df.filter(F.contains(hay, F.lit(want))).select(*keep, F.posexplode(starts).alias("hit", "col"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def excerpt(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` bytes, cut at a character boundary and marked with an ellipsis; shorter texts as they are."""
    raw = F.encode(text, "UTF-8")
    tail = lambda k: F.conv(F.hex(F.substring(raw, limit + 1 - k, 1)), 16, 10).cast("int")  # noqa: E731  the byte after a cut k bytes shorter
    inside = lambda k: tail(k).bitwiseAND(F.lit(0xC0)) == 0x80
    keep = F.when(~inside(0), limit).when(~inside(1), limit - 1).when(~inside(2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"), F.lit("…")))
