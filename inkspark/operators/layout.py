"""Layout of text runs: lines, blocks, kinds of blocks, tables.

Lines and tables are folds over the runs of one page (:func:`fold_lines`, :func:`find_tables`), which run page after
page over sorted rows; a page's runs are bounded by its size.  Kinds are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: List marks and beginnings of captions.
LIST_MARKS = ("•", "-", "*", "–", "—", "‣", "")
CAPTIONS = ("figure ", "figure:", "fig. ", "fig ", "table ", "table:", "listing ", "equation ")
_CAPTION = "^(?i:" + "|".join(c.replace(".", "\\.") for c in CAPTIONS) + ")"
_LIST = r"^(?:(?:[" + "".join("\\-" if m == "-" else m for m in LIST_MARKS) + r"]) |[0-9]+[.)] |[A-Za-z]\. )"


def block_kind(text: Column, size: Column, body: Column) -> Column:
    """heading, paragraph, list, caption or other; patterns decide before sizes."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    caption = bare.rlike(_CAPTION)
    return (
        F.when((F.octet_length(bare) == 0) | (body <= 0), "other").when(bare.rlike(_LIST), "list").when(caption & (size <= body * 1.1), "caption")
        .when(size >= body * 1.25, "heading").when(size >= body * 0.8, "paragraph").otherwise("other")
    )


@dataclass(slots=True)
class Run:
    text: str
    x: float
    y: float
    size: float
    w: float
    vert: bool = False


@dataclass(slots=True)
class Line:
    runs: list[Run]
    x: float
    y: float
    size: float
    vert: bool
    text: str = ""


@dataclass
class Block:
    lines: list[Line] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join(line.text for line in self.lines)

    @property
    def size(self) -> float:
        return max((line.size for line in self.lines), default=0.0)


def joined_runs(runs: Sequence[Run], vertical: bool, gap: float) -> str:
    """Texts of ordered runs, with a space where the next begins at least ``gap`` sizes after the last has ended."""
    out = [runs[0].text] if runs else []
    for a, b in zip(runs, runs[1:], strict=False):
        space = (a.y - a.w - b.y) if vertical else (b.x - a.x - a.w)
        if space >= gap * max(a.size, b.size) and not out[-1].endswith(" ") and not b.text.startswith(" "):
            out.append(" ")
        out.append(b.text)
    return "".join(out)


def fold_lines(runs: Sequence[Run], tolerance: float = 0.5, gap: float = 0.15) -> list[Line]:
    """Lines of runs in drawing order: a run joins the last line if it is near enough to where that line began."""
    lines: list[Line] = []
    for run in runs:
        last = lines[-1] if lines else None
        if last is not None and last.vert == run.vert:
            off = abs(run.x - last.x) if run.vert else abs(run.y - last.y)
            if off <= tolerance * max(run.size, last.size):
                last.runs.append(run)
                last.size = max(last.size, run.size)
                continue
        lines.append(Line([run], run.x, run.y, run.size, run.vert))
    for line in lines:
        line.runs.sort(key=(lambda r: -r.y) if line.vert else (lambda r: r.x))
        line.text = joined_runs(line.runs, line.vert, gap)
        line.x, line.y = line.runs[0].x, line.runs[0].y
    return lines


def fold_blocks(lines: Sequence[Line]) -> list[Block]:
    """Blocks of lines that follow each other closely."""
    blocks: list[Block] = []
    for line in lines:
        near = False
        if blocks:
            last = blocks[-1].lines[-1]
            dx, dy = line.x - last.x, line.y - last.y
            if last.vert == line.vert:
                near = 0 <= -dx <= 1.5 * last.size and abs(dy) <= 2 * last.size if line.vert else abs(dy) <= 1.5 * last.size and abs(dx) <= 2 * last.size
        if near:
            blocks[-1].lines.append(line)
        else:
            blocks.append(Block([line]))
    return blocks


def page_text(runs: Sequence[Run]) -> str:
    """A page's text: lines by line feeds, blocks by two."""
    return "\n\n".join(b.text for b in fold_blocks(fold_lines(runs)))


def body_size(lines: Sequence[Line]) -> float:
    """The most frequent size of lines; of equals the one that got there first."""
    counts: dict[float, int] = {}
    best, most = 0.0, 0
    for line in lines:
        counts[line.size] = counts.get(line.size, 0) + 1
        if counts[line.size] > most:
            best, most = line.size, counts[line.size]
    return best


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str]]
    members: set[int]  # indices of the lines that the table takes
    x: float = 0.0
    y: float = 0.0
    w: float = 0.0
    h: float = 0.0


@dataclass
class _Band:
    """Lines of one table row: first its seeds, then what is attached."""

    y: float
    size: float
    lines: list[int]
    edges: set[int]


#: Tolerances of edges (points), and of gutters, bands, attached lines and regions (in sizes).
EDGE, SUPPORT, GUTTER, BAND, ATTACH, REGION, WORD = 2.0, 3, 1.5, 0.5, 1.6, 5.0, 0.15


def _edges(lines: Sequence[Line]) -> tuple[list[float], list[set[int]]]:
    """Column edges from left to right, and per line those that a gutter (or the line's begin) stands before."""
    means: list[float] = []
    sizes: list[int] = []
    for x in sorted(r.x for line in lines for r in line.runs):
        if means and x - means[-1] <= EDGE:
            sizes[-1] += 1
            means[-1] += (x - means[-1]) / sizes[-1]
        else:
            means.append(x)
            sizes.append(1)
    touched: list[set[int]] = []
    for line in lines:
        ends = [float("-inf"), *(r.x + r.w for r in line.runs)]
        free = [r.x for r, end in zip(line.runs, ends, strict=False) if r.x - end >= GUTTER * r.size]
        near = (next((k for k, m in enumerate(means) if abs(x - m) <= EDGE), None) for x in free)
        touched.append({k for k in near if k is not None})
    kept = [k for k in range(len(means)) if sum(k in t for t in touched) >= SUPPORT]
    edges = [means[k] for k in kept]
    named = {k: next((e for e, x in enumerate(edges) if abs(means[k] - x) <= EDGE), None) for k in range(len(means))}
    return edges, [{named[k] for k in t} - {None} for t in touched]


def _bands(lines: Sequence[Line], hits: Sequence[set[int]]) -> list[_Band]:
    """Lines on two edges or more, from the top down; those on about one height are one band."""
    bands: list[_Band] = []
    for i in sorted((i for i, h in enumerate(hits) if len(h) >= 2), key=lambda i: -lines[i].y):
        line = lines[i]
        if bands and abs(line.y - bands[-1].y) <= BAND * max(line.size, bands[-1].size):
            bands[-1].lines.append(i)
            bands[-1].edges |= hits[i]
            bands[-1].size = max(bands[-1].size, line.size)
        else:
            bands.append(_Band(line.y, line.size, [i], set(hits[i])))
    for band in bands:
        band.y = sum(lines[i].y for i in band.lines) / len(band.lines)
    return bands


def _regions(bands: Sequence[_Band]) -> list[list[_Band]]:
    """Bands without a great gap between them."""
    out: list[list[_Band]] = []
    for band in bands:
        if out and out[-1][-1].y - band.y <= REGION * max(out[-1][-1].size, band.size):
            out[-1].append(band)
        else:
            out.append([band])
    return out


def _cell(runs: list[Run]) -> str:
    """A cell's runs: from the top down, then from the left; lines joined by line feeds."""
    rows: list[list[Run]] = []
    for run in sorted(runs, key=lambda r: (-r.y, r.x)):
        if rows and abs(run.y - rows[-1][-1].y) <= BAND * max(run.size, rows[-1][-1].size):
            rows[-1].append(run)
        else:
            rows.append([run])
    return "\n".join(joined_runs(row, False, WORD) for row in rows).strip()


def _table(lines: Sequence[Line], region: list[_Band], edges: list[float], hits: Sequence[set[int]]) -> Table | None:
    columns = set().union(*(b.edges for b in region))
    if len(region) < 2 or len(columns) < 2:
        return None
    taken = {b: list(region[b].lines) for b in range(len(region))}
    for i, own in enumerate(hits):  # a line on one edge alone is a wrapped part of the nearest row
        if len(own) == 1 and own <= columns:
            near = min(range(len(region)), key=lambda b: abs(lines[i].y - region[b].y))
            if abs(lines[i].y - region[near].y) <= ATTACH * max(lines[i].size, region[near].size):
                taken[near].append(i)
    first = min(columns)
    whole = [b for b in range(len(region)) if first in region[b].edges]  # the outer rows begin at the left edge
    rows = list(range(whole[0], whole[-1] + 1)) if whole else []
    if len(rows) < 2:
        return None
    used = sorted(set().union(*(region[b].edges for b in rows)))
    grid = []
    for b in rows:
        cells: list[list[Run]] = [[] for _ in used]
        for i in taken[b]:
            for run in lines[i].runs:
                cells[max((k for k, e in enumerate(used) if edges[e] <= run.x + EDGE), default=0)].append(run)
        grid.append([_cell(c) for c in cells])
    members = {i for b in rows for i in taken[b]}
    runs = [r for i in members for r in lines[i].runs]
    left, top = min(r.x for r in runs), max(r.y for r in runs)
    sizes = [region[b].size for b in rows]
    head = 1 if sizes[0] >= 1.15 * sorted(sizes)[len(sizes) // 2] else 0
    return Table(grid[0] if head else [], grid[head:], members, left, top, max(r.x + r.w for r in runs) - left, top - min(r.y for r in runs))


def find_tables(lines: Sequence[Line]) -> list[Table]:
    """Tables on a page.

    Left edges of runs become columns where ``SUPPORT`` lines or more begin there, or go on there behind a gutter.  Lines on two
    edges are rows; lines on one edge near a row are wrapped parts of its cells.  Rows apart by more than ``REGION`` sizes
    belong to different tables, and a table's first and last rows begin at its left edge.  The first row is the header where it is
    visibly larger than the middle size."""
    edges, hits = _edges(lines)
    if len(edges) < 2:
        return []
    found = (_table(lines, region, edges, hits) for region in _regions(_bands(lines, hits)))
    return [t for t in found if t is not None]


_RUN_COLUMNS = ("text", "x", "y", "size", "w", "vert")
_MEASURES = ("x", "y", "size", "w")


def _by_page(runs: DataFrame, fold: Callable[[list[Run]], list[tuple]], schema: str) -> DataFrame:
    """Rows (path, page, ...) that ``fold`` makes of each page's runs in order.

    Rows come sorted by page, so one pass folds page after page, and a batch holds many of them: pages may be as small as a
    line.  Only the runs of one page are held."""
    ship(runs.sparkSession)
    target = to_arrow_schema(StructType.fromDDL("path string, page int, " + schema))

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        page, held = None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            keys = zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)
            # a missing measure is NaN, which is near nothing
            values = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in columns[2:]]
            for key, run in zip(keys, map(Run, *values), strict=True):
                if key != page and held:
                    out += [(*page, *row) for row in fold(held)]
                    held = []
                    if len(out) >= 4096:
                        yield _batch(out, target)
                        out = []
                page = key
                held.append(run)
        if held:
            out += [(*page, *row) for row in fold(held)]
        if out:
            yield _batch(out, target)

    columns = [F.col(c).cast("double").alias(c) if c in _MEASURES else F.col(c) for c in _RUN_COLUMNS]
    ordered = runs.select(F.col("path").cast("string").alias("path"), F.col("page").cast("int").alias("page"), "run_idx", *columns).repartition("path", "page").sortWithinPartitions("path", "page", "run_idx")
    return ordered.select("path", "page", *_RUN_COLUMNS).mapInArrow(fold_all, StructType.fromDDL("path string, page int, " + schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lines_of(runs: DataFrame) -> DataFrame:
    """(path, page, line, block, text, x, y, size, vert) of ``pdf_runs``, page by page, and ``x_end``, ``y_low`` and ``y_high``: the
    greatest x and the range of y at which runs of the line begin."""

    def page(held: list[Run]) -> list[tuple]:
        rows = []
        for b, block in enumerate(fold_blocks(fold_lines(held))):
            for line in block.lines:
                ys = [r.y for r in line.runs]
                rows.append((len(rows), b, line.text, line.x, line.y, line.size, line.vert, max(r.x for r in line.runs), min(ys), max(ys)))
        return rows

    return _by_page(runs, page, "line int, block int, text string, x double, y double, size double, vert boolean, x_end double, y_low double, y_high double")


def tables_of(runs: DataFrame) -> DataFrame:
    """(path, page, idx, headers, rows, members, x, y, w, h) of the tables on each page; ``members`` are the lines they take."""

    def page(held: list[Run]) -> list[tuple]:
        return [(k, t.headers, t.rows, sorted(t.members), t.x, t.y, t.w, t.h) for k, t in enumerate(find_tables(fold_lines(held)))]

    return _by_page(runs, page, "idx int, headers array<string>, rows array<array<string>>, members array<int>, x double, y double, w double, h double")


def sheet_of(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks with their kinds: (path, page, block, kind, text, x, y, w, h, size), by the page's own body size.

    Lines that a table takes are not in blocks too; a block of such lines alone is no row.  The body size is that of all lines."""
    from .documents import first_to_max, joined_text

    body = first_to_max(lines, ["path", "page"], "size", "line", "body")
    if tables is not None:
        taken = tables.select("path", "page", F.explode("members").alias("line"))
        lines = lines.join(taken, ["path", "page", "line"], "left_anti")
    text = joined_text(lines, ["path", "page", "block"], ["line"], "text", "\n")
    shape = lines.groupBy("path", "page", "block").agg(
        F.min("x").alias("x"), F.min("y_low").alias("y"), (F.max("x_end") - F.min("x")).alias("w"), (F.max("y_high") - F.min("y_low")).alias("h"), F.max("size").alias("size")
    )
    both = text.join(shape, ["path", "page", "block"]).join(body, ["path", "page"])
    return both.select("path", "page", "block", block_kind(F.col("text"), F.col("size"), F.col("body")).alias("kind"), "text", "x", "y", "w", "h", "size")
