"""Operators on runs, paragraphs and pages: flat text, revisions, page lists, trees, newest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of a paragraph's children, and which of them each view of the revisions shows.
PLAIN, INSERTED, DELETED, MOVED_FROM, MOVED_TO = "run", "ins", "del", "moveFrom", "moveTo"
VIEWS = {"accept": (PLAIN, INSERTED, MOVED_TO), "reject": (PLAIN, DELETED, MOVED_FROM)}


def joined_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str, out: str = "text") -> DataFrame:
    """Texts of a group in order, joined; nulls count as empty."""
    item = F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    ordered = F.array_sort(F.collect_list(item))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda e: e["__t"]), separator).alias(out))


def in_view(runs: DataFrame, kind: str, text: str, deleted_text: str, view: str = "accept") -> DataFrame:
    """Runs that a view of the revisions shows; rejecting turns deleted text into text."""
    shown = runs.filter(F.col(kind).isin(*VIEWS[view]))
    if view == "accept":
        return shown.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return shown.withColumn(text, F.coalesce(F.when(F.col(kind).isin(DELETED, MOVED_FROM), F.col(deleted_text)), F.col(text), F.lit("")))


def flat_text(runs: DataFrame, document: Sequence[str], paragraph: Sequence[str], run: Sequence[str], kind: str, text: str, deleted_text: str, view: str = "accept") -> DataFrame:
    """Text of each document: runs of a paragraph run on, paragraphs are joined by line feeds; a paragraph without shown
    runs is an empty line."""
    shown = F.col(kind).isin(*VIEWS[view])
    value = F.coalesce(F.col(text), F.lit("")) if view == "accept" else F.coalesce(F.when(F.col(kind).isin(DELETED, MOVED_FROM), F.col(deleted_text)), F.col(text), F.lit(""))
    marked = runs.withColumn("__v", F.when(shown, value).otherwise(""))
    paragraphs = joined_text(marked, [*document, *paragraph], run, "__v", "", "__p")
    return joined_text(paragraphs, document, paragraph, "__p", "\n")


def side_blocks(sections: DataFrame, content: DataFrame, side: str = "headers", section: int = -1, kind: str = "") -> DataFrame:
    """Rows of ``content`` (path, part, ...) that stand in the headers or footers of one section of each document, with the
    ``kind`` of the reference (default, first, even) and its place ``ord``; a negative section is the last, an empty kind
    means all.  A document with fewer sections raises; one without any has no rows."""
    at = F.col("section_idx")
    last = F.max(at)
    found = F.max_by(side, at) if section < 0 else F.when(last < section, F.raise_error(F.concat(F.lit(f"no section {section} in "), F.col("path")))).otherwise(F.max_by(side, F.when(at == section, at)))
    refs = sections.groupBy("path").agg(found.alias("__refs")).select("path", F.posexplode("__refs").alias("ord", "kind", "part"))
    return (refs.filter(F.col("kind") == kind) if kind else refs).join(content, ["path", "part"])


def selected_pages(pages: DataFrame, wanted: DataFrame, page: str, out: str) -> DataFrame:
    """The pages of a list, in its order and as often as it names them: ``wanted`` has ``out`` and ``page``."""
    return wanted.join(pages, page)


def merged_pages(documents: Sequence[DataFrame], page: str, out: str) -> DataFrame:
    """All pages of several documents behind one another, numbered through from 0; equal pages stay apart."""
    parts = [d.withColumn("__doc", F.lit(k)) for k, d in enumerate(documents)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sizes = union.groupBy("__doc").agg((F.max(page) + 1).alias("__n"))
    firsts = sizes.alias("a").join(sizes.alias("b"), F.col("b.__doc") < F.col("a.__doc"), "left").groupBy(F.col("a.__doc").alias("__doc")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__first"))
    return union.join(F.broadcast(firsts), "__doc").withColumn(out, F.col("__first") + F.col(page)).drop("__doc", "__first")


def newest(versions: DataFrame, key: str, revision: str, values: Sequence[str]) -> DataFrame:
    """Of several versions of an object the one of the last revision."""
    best = versions.groupBy(key).agg(F.max_by(F.struct(revision, *values), F.col(revision)).alias("__v"))
    return best.select(key, F.col(f"__v.{revision}").alias(revision), *(F.col(f"__v.{v}").alias(v) for v in values))


def tree_paths(spark: SparkSession, nodes: DataFrame, node: str, parent: str, title: str, separator: str = "/") -> DataFrame:
    """(node, depth, path) of every node that a root reaches; a node whose parent is null is a root.

    A recursive query: one join per level, and levels are few.
    """
    nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(title).alias("title")).createOrReplaceTempView("__tree_nodes")
    return spark.sql(
        f"""WITH RECURSIVE walk(node, depth, path) AS (
            SELECT node, 0, title FROM __tree_nodes WHERE parent IS NULL
            UNION ALL SELECT n.node, w.depth + 1, concat(w.path, '{separator}', n.title) FROM walk w JOIN __tree_nodes n ON n.parent = w.node)
        SELECT node, depth, path FROM walk"""
    )


def first_free(used: DataFrame, number: str, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest number from 1 that is not used, per group."""
    distinct = used.filter(F.col(number) >= 1).select(*keys, number).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    run = distinct.withColumn("__r", rank).filter(F.col(number) == F.col("__r"))
    groups = used.select(*keys).distinct() if keys else None
    free = run.groupBy(*keys).agg((F.max("__r") + 1).alias("free"))
    return free if groups is None else groups.join(free, list(keys), "left").withColumn("free", F.coalesce("free", F.lit(1)))


def first_to_max(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """The most frequent value per group; of equals the one that reached that count first, in order."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.max(order).alias("__last"))
    best = counted.groupBy(*keys).agg(F.min_by(F.col(value), F.struct((-F.col("__n")).alias("n"), F.col("__last").alias("l"))).alias(out))
    return best


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, out: str) -> DataFrame:
    """Numbers the runs of rows between those where ``new`` holds; the first row begins run 0."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0))).withColumn(out, F.sum("__new").over(over)).drop("__new")
