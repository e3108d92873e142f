"""Spreadsheets: every part of a workbook as rows of fixed tables."""

from __future__ import annotations

import re

from .package import FormatError, attr, child, children, flag, local, parts, rels, text_of, xml

TABLES = {
    "sheets": "ord int, name string, sheet_id string, state string, part string, dimension string, date1904 boolean",
    "cells": "sheet string, row int, col int, file_ord int, style_idx int, cell_type string, raw string, has_formula boolean, f_content string, f_type string, f_si int, f_ref string, inline_text string",
    "rows": "sheet string, row int, hidden boolean, height double",
    "cols": "sheet string, ord int, min int, max int, width double, has_width boolean, hidden boolean, best_fit boolean, custom_width boolean, outline_level int, collapsed boolean",
    "merges": "sheet string, ord int, ref string, first_row int, last_row int, first_col int, last_col int, anchor_row int, anchor_col int",
    "hyperlinks": "sheet string, ord int, ref string, first_row int, last_row int, first_col int, last_col int, target string, location string, display string, tooltip string, external boolean",
    "defined_names": "ord int, name string, refers_to string, local_sheet string, hidden boolean, comment string",
    "shared_strings": "idx int, text string",
    "rich_runs": "idx int, run_idx int, text string, bold boolean, italic boolean, size double, font string, color string",
    "xfs": "style_idx int, num_fmt_id int, font_id int, fill_id int, border_id int, xf_id int, apply_number_format boolean, apply_font boolean, apply_fill boolean, apply_border boolean",
    "num_fmts": "num_fmt_id int, code string",
    "fonts": "font_id int, name string, size double, bold boolean, italic boolean, underline string, strike boolean, color string",
    "fills": "fill_id int, pattern string, fg string, bg string",
    "borders": "border_id int, side string, style string, color string",
    "theme_colors": "idx int, color string",
}
_TYPES = {"b": "bool", "d": "date", "e": "error", "n": "number", "s": "shared_string", "str": "formula", "inlineStr": "inline_string"}
#: The slots of a theme's colours in index order.
_THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    if not re.fullmatch("[A-Z]{1,3}", letters) or n > 16384:
        raise FormatError(f"bad column {letters!r}")
    return n


def column_name(n: int) -> str:
    if not 1 <= n <= 16384:
        raise FormatError(f"bad column number {n}")
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def split_ref(ref: str) -> tuple[int, int]:
    """(col, row) of a cell reference."""
    found = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]*)", ref.replace("$", ""))
    if not found or int(found[2]) > 1048576:
        raise FormatError(f"bad cell reference {ref!r}")
    return column_number(found[1]), int(found[2])


def area(ref: str) -> tuple[int, int, int, int]:
    """first_row, last_row, first_col, last_col of ``A1:B2`` or ``A1``, in order whatever the order of its corners."""
    a, _, b = ref.partition(":")
    (c1, r1), (c2, r2) = split_ref(a), split_ref(b or a)
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def _color(node) -> str | None:
    if node is None:
        return None
    if attr(node, "rgb"):
        return attr(node, "rgb")
    if attr(node, "theme"):
        return f"theme:{attr(node, 'theme')}" + (f":{attr(node, 'tint')}" if attr(node, "tint") else "")
    return f"indexed:{attr(node, 'indexed')}" if attr(node, "indexed") else None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _styles(found: dict[str, bytes], out: dict[str, list[tuple]]) -> None:
    root = xml(found, "xl/styles.xml") if "xl/styles.xml" in found else None
    out["num_fmts"] = [(int(attr(f, "numFmtId", "0")), attr(f, "formatCode")) for f in children(child(root, "numFmts"), "numFmt")]
    for k, f in enumerate(children(child(root, "fonts"), "font")):
        size = _number(attr(child(f, "sz"), "val"))
        underline = None if child(f, "u") is None else attr(child(f, "u"), "val", "single")
        out["fonts"].append((k, attr(child(f, "name"), "val") or None, size, flag(child(f, "b")), flag(child(f, "i")), underline, flag(child(f, "strike")), _color(child(f, "color"))))
    for k, f in enumerate(children(child(root, "fills"), "fill")):
        p = child(f, "patternFill")
        out["fills"].append((k, attr(p, "patternType") or None, _color(child(p, "fgColor")), _color(child(p, "bgColor"))))
    for k, b in enumerate(children(child(root, "borders"), "border")):
        out["borders"] += [(k, local(s.tag), attr(s, "style"), _color(child(s, "color"))) for s in b if attr(s, "style")]
    for k, x in enumerate(children(child(root, "cellXfs"), "xf")):
        ids = [int(attr(x, n, "0") or 0) for n in ("numFmtId", "fontId", "fillId", "borderId", "xfId")]
        out["xfs"].append((k, *ids, *(attr(x, f"apply{n}", "1") not in ("0", "false") for n in ("NumberFormat", "Font", "Fill", "Border"))))
    theme = child(child(xml(found, "xl/theme/theme1.xml"), "themeElements"), "clrScheme") if "xl/theme/theme1.xml" in found else None
    if theme is not None:
        for k, slot in enumerate(_THEME):
            c = child(theme, slot)
            value = attr(child(c, "srgbClr"), "val") or attr(child(c, "sysClr"), "lastClr")
            out["theme_colors"].append((k, value or None))


def _strings(found: dict[str, bytes], part: str, out: dict[str, list[tuple]]) -> None:
    for k, si in enumerate(children(xml(found, part), "si") if part in found else []):
        runs = children(si, "r")
        if not runs:
            out["shared_strings"].append((k, text_of(child(si, "t"))))
            continue
        for j, r in enumerate(runs):
            p = child(r, "rPr")
            out["rich_runs"].append((k, j, text_of(child(r, "t")), flag(child(p, "b")), flag(child(p, "i")), _number(attr(child(p, "sz"), "val")), attr(child(p, "rFont"), "val") or None, _color(child(p, "color"))))
        out["shared_strings"].append((k, "".join(text_of(child(r, "t")) for r in runs)))


def _sheet(found: dict[str, bytes], name: str, part: str, out: dict[str, list[tuple]]) -> str:
    root = xml(found, part)
    links = rels(found, part)
    file_ord = 0
    at_row = 0
    cells: dict[tuple[int, int], int] = {}
    for row in children(child(root, "sheetData"), "row"):
        at_row = int(attr(row, "r")) if attr(row, "r") else at_row + 1
        if not 1 <= at_row <= 1048576:
            raise FormatError(f"{part}: bad row {at_row}")
        out["rows"].append((name, at_row, attr(row, "hidden") in ("1", "true"), _number(attr(row, "ht"))))
        at_col = 0
        for c in children(row, "c"):
            col, r = split_ref(attr(c, "r")) if attr(c, "r") else (at_col + 1, at_row)
            at_col = col
            f, v, inline = child(c, "f"), child(c, "v"), child(c, "is")
            raw = text_of(v)
            content = text_of(inline) if inline is not None else None
            si = attr(f, "si")
            out["cells"].append((
                name, r, col, file_ord, int(attr(c, "s", "-1") or -1), _TYPES.get(attr(c, "t"), "unset"), raw, f is not None, text_of(f) if f is not None else "",
                attr(f, "t"), int(si) if si else None, attr(f, "ref"), content,
            ))
            if raw or f is not None or content:
                cells.setdefault((r, col), file_ord)
            file_ord += 1
    claimed: set[tuple[int, int]] = set()
    for k, m in enumerate(children(child(root, "mergeCells"), "mergeCell")):
        ref = attr(m, "ref")
        if not ref:
            continue
        r1, r2, c1, c2 = area(ref)
        inside = [p for p in cells if r1 <= p[0] <= r2 and c1 <= p[1] <= c2 and p not in claimed]
        anchor = min(inside, key=lambda p: (p[0], cells[p]), default=(r1, c1))
        claimed.update(p for p in cells if r1 <= p[0] <= r2 and c1 <= p[1] <= c2)
        out["merges"].append((name, k, ref, r1, r2, c1, c2, *anchor))
    for k, c in enumerate(children(child(root, "cols"), "col")):
        on = lambda n: attr(c, n) in ("1", "true")  # noqa: B023, E731
        width = _number(attr(c, "width"))
        out["cols"].append((name, k, int(attr(c, "min", "1")), int(attr(c, "max", "1")), width, width is not None, on("hidden"), on("bestFit"), on("customWidth"), int(attr(c, "outlineLevel", "0")), on("collapsed")))
    for k, h in enumerate(children(child(root, "hyperlinks"), "hyperlink")):
        target = links.get(attr(h, "id"), ("", "", False))
        out["hyperlinks"].append((name, k, attr(h, "ref"), *area(attr(h, "ref")), target[1], attr(h, "location"), attr(h, "display"), attr(h, "tooltip"), target[2]))
    return attr(child(root, "dimension"), "ref")


def parse(data: bytes, sheet: str | None = None) -> dict[str, list[tuple]]:
    """All tables of a workbook; with ``sheet`` (case ignored) the cells of that sheet alone."""
    found = parts(data)
    book_part = next((t for k, t, _ in rels(found, "").values() if k == "officeDocument"), "xl/workbook.xml") if "_rels/.rels" in found else "xl/workbook.xml"
    book = xml(found, book_part)
    if local(book.tag) != "workbook":
        raise FormatError(f"{book_part}: the root is {local(book.tag)}, not workbook")
    out: dict[str, list[tuple]] = {t: [] for t in TABLES}
    links = rels(found, book_part)
    date1904 = attr(child(book, "workbookPr"), "date1904") in ("1", "true")
    sheets = children(child(book, "sheets"), "sheet")
    names = [attr(s, "name") for s in sheets]
    if sheet is not None and sheet.lower() not in [n.lower() for n in names]:
        raise FormatError(f"no sheet {sheet!r}")
    for k, s in enumerate(sheets):
        part = links.get(attr(s, "id"), ("", "", False))[1]
        dimension = ""
        if part in found and (sheet is None or names[k].lower() == sheet.lower()):
            dimension = _sheet(found, names[k], part, out)
        out["sheets"].append((k, names[k], attr(s, "sheetId"), attr(s, "state", "visible"), part, dimension, date1904))
    for k, n in enumerate(children(child(book, "definedNames"), "definedName")):
        owner = attr(n, "localSheetId")
        out["defined_names"].append((k, attr(n, "name"), text_of(n), names[int(owner)] if owner and int(owner) < len(names) else None, attr(n, "hidden") in ("1", "true"), attr(n, "comment") or None))
    _strings(found, next((t for k, t, _ in links.values() if k == "sharedStrings"), "xl/sharedStrings.xml"), out)
    _styles(found, out)
    return out


def display_rows(data: bytes, sheet: str, raw: bool = False) -> list[list[str]]:
    """Rows of a sheet as they are shown: gaps are empty, nothing follows the last cell."""
    from ..functions import numfmt

    t = parse(data, sheet)
    strings = [s for _, s in t["shared_strings"]]
    codes, fmt = dict(t["num_fmts"]), {x[0]: x[1] for x in t["xfs"]}
    date1904 = bool(t["sheets"] and t["sheets"][0][6])
    grid: dict[int, dict[int, str]] = {r[1]: {} for r in t["rows"]}
    for _, row, col, _, style, kind, value, has_formula, *_, inline in t["cells"]:
        text = shown_value(kind, value, inline, strings)
        if text == "" and not has_formula:
            continue
        if not raw and kind in ("number", "unset", "date") and style > 0:
            serial = text
            if kind == "date" and (number := numfmt.iso_to_serial(text)) is not None:
                serial = numfmt.significant(number, 15)
            text = numfmt.display_id(serial, fmt.get(style, 0), codes, "number", date1904)
        grid.setdefault(row, {}).setdefault(col, text)
    last = max((r for r, cells in grid.items() if cells), default=0)
    return [[grid.get(r, {}).get(c, "") for c in range(1, max(grid.get(r, {}), default=0) + 1)] for r in range(1, last + 1)]


def shown_value(kind: str, raw: str, inline: str | None, strings: list[str]) -> str:
    """A cell's text before any number format."""
    from ..functions import numfmt

    if kind == "shared_string":
        if not raw.strip():
            return ""
        k = int(raw)
        if not 0 <= k < len(strings):
            raise FormatError(f"shared string index out of range: {k}")
        return strings[k]
    if kind == "inline_string":
        return inline if inline is not None else raw
    if kind == "bool":
        return {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
    if kind in ("number", "unset") and (x := numfmt.number_of(raw)) is not None:
        digits = numfmt.plain(abs(x)).replace(".", "").lstrip("0")
        return numfmt.significant(x, 15) if len(digits) > 15 else numfmt.plain(x)
    return raw
