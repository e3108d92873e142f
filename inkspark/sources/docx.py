"""Word-processing documents: body, notes, comments, styles, numbering and properties as rows of fixed tables."""

from __future__ import annotations

import re
import shlex

from .package import FormatError, attr, child, children, flag, local, parts, rels, text_of, xml

_RUN = (
    "part string, block_path array<int>, kid_idx int, run_idx int, kid_kind string, text string, del_text string, bold boolean, italic boolean, underline string, strike boolean, "
    "size_half_pts int, font string, color string, color_theme string, highlight string, vert_align string, style_id string, link_id string, note_ref string, image_rel string"
)
TABLES = {
    "documents": "title string, creator string, last_modified_by string, created string, modified string, subject string, keywords string, description string, category string, application string, pages int, words int",
    "blocks": "part string, block_path array<int>, kind string, section_idx int, author string, revision_id string",
    "paragraphs": "part string, block_path array<int>, style_id string, align string, num_id int, ilvl int, indent_left int, indent_right int, first_line int, outline_level int, keep_next boolean, page_break_before boolean, mark_revision string, old_style_id string",
    "runs": _RUN,
    "paragraph_runs": "part string, block_path array<int>, run_idx int, kid_kind string, text string, del_text string",  # paragraphs without runs have a row too
    "table_cells": "part string, block_path array<int>, row int, cell int, grid_span int, v_merge string, shading string, width int",
    "sections": "section_idx int, page_width int, page_height int, margin_top int, margin_bottom int, margin_left int, margin_right int, orientation string, headers map<string,string>, footers map<string,string>",
    "styles": "style_id string, kind string, name string, based_on string, is_default boolean, bold boolean, italic boolean, size_half_pts int, color string",
    "numbering": "num_id int, ilvl int, format string, level_text string, start int",
    "notes": "kind string, id int, text string",
    "comments": "id int, author string, date string, initials string, text string",
    "hyperlinks": "rel_id string, target string, external boolean",
    "images": "rel_id string, part string, content_type string, data binary",
    "fields": "part string, block_path array<int>, run_idx int, keyword string, arguments array<string>, instruction string",
    "bookmarks": "ord int, part string, id string, name string",
    "custom_props": "name string, kind string, value string",
    "raw_parts": "name string, data binary",
}
_MAIN = "word/document.xml"
_MAX_DEPTH = 64
_FIELDS = ("TOC", "TC", "PAGE", "NUMPAGES", "PAGEREF", "HYPERLINK")


def _int(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?[0-9]+", text or "") else None


def field_instruction(text: str) -> tuple[str, list[str]]:
    """Keyword (``unsupported`` for others) and arguments, quotes removed."""
    bare = text.strip()
    try:
        words = shlex.split(bare.replace("\\", "\\\\"), posix=True)
    except ValueError:
        words = bare.split()
    return (words[0], words[1:]) if words and words[0] in _FIELDS else ("unsupported", [bare])


class _Reader:
    def __init__(self, found: dict[str, bytes]):
        self.found = found
        self.out: dict[str, list[tuple]] = {t: [] for t in TABLES}
        self.section = 0
        self.used: set[str] = set()

    def run_text(self, r) -> tuple[str, str]:
        text, deleted = [], []
        for c in r:
            n = local(c.tag)
            if n == "t":
                text.append(c.text or "")
            elif n == "delText":
                deleted.append(c.text or "")
            elif n == "tab":
                text.append("\t")
            elif n == "br":
                text.append("\f" if attr(c, "type") == "page" else "\n")
            elif n == "cr":
                text.append("\n")
            elif n == "noBreakHyphen":
                text.append(" ")
        return "".join(text), "".join(deleted)

    def run(self, part: str, path: list[int], kid: int, index: int, kind: str, r, link: str = "") -> None:
        p = child(r, "rPr")
        text, deleted = self.run_text(r)
        fonts, color, note = child(p, "rFonts"), child(p, "color"), child(r, "footnoteReference")
        note = note if note is not None else child(r, "endnoteReference")
        blip = next((x for x in r.iter() if local(x.tag) == "blip"), None)
        underline = child(p, "u")
        self.out["runs"].append((
            part, path, kid, index, kind, text, deleted, flag(child(p, "b")), flag(child(p, "i")), attr(underline, "val") or None, flag(child(p, "strike")),
            _int(attr(child(p, "sz"), "val")), attr(fonts, "ascii") or None, attr(color, "val") or None, attr(color, "themeColor") or None, attr(child(p, "highlight"), "val") or None,
            attr(child(p, "vertAlign"), "val") or None, attr(child(p, "rStyle"), "val") or None, link or None, attr(note, "id") or None, attr(blip, "embed") or None,
        ))
        for f in children(r, "instrText"):
            key, args = field_instruction(f.text or "")
            self.out["fields"].append((part, path, index, key, args, f.text or ""))

    def paragraph(self, part: str, path: list[int], p, siblings: list) -> None:
        pr = child(p, "pPr")
        num, ind, rpr = child(pr, "numPr"), child(pr, "ind"), child(pr, "rPr")
        mark = next((k for k in ("ins", "del", "moveFrom", "moveTo") if child(rpr, k) is not None), None)
        old = child(child(pr, "pPrChange"), "pPr")
        self.out["paragraphs"].append((
            part, path, attr(child(pr, "pStyle"), "val") or None, attr(child(pr, "jc"), "val") or None, _int(attr(child(num, "numId"), "val")), _int(attr(child(num, "ilvl"), "val")),
            _int(attr(ind, "left") or attr(ind, "start")), _int(attr(ind, "right") or attr(ind, "end")), _int(attr(ind, "firstLine")), _int(attr(child(pr, "outlineLvl"), "val")),
            flag(child(pr, "keepNext")), flag(child(pr, "pageBreakBefore")), mark, attr(child(old, "pStyle"), "val") or None,
        ))
        index = 0
        for kid, k in enumerate(x for x in p if local(x.tag) != "pPr"):
            n = local(k.tag)
            if n == "r":
                self.run(part, path, kid, index, "run", k)
                index += 1
            elif n == "hyperlink":
                for r in children(k, "r"):
                    self.run(part, path, kid, index, "run", r, attr(k, "id") or "#" + attr(k, "anchor"))
                    index += 1
            elif n in ("ins", "del", "moveFrom", "moveTo"):
                for r in (x for x in k.iter() if local(x.tag) == "r"):
                    inner = next((local(x.tag) for x in k if local(x.tag) in ("ins", "del") and r in list(x)), n)
                    self.run(part, path, kid, index, inner if n == "ins" else n, r)
                    index += 1
            elif n == "fldSimple":
                key, args = field_instruction(attr(k, "instr"))
                self.out["fields"].append((part, path, index, key, args, attr(k, "instr")))
                for r in children(k, "r"):
                    self.run(part, path, kid, index, "field", r)
                    index += 1
        for box in p.iter():
            if local(box.tag) == "txbxContent":
                siblings.append(box)

    def blocks(self, part: str, node, path: list[int], kind: str = "") -> None:
        """Children of a body, cell, note or wrapper; text boxes follow the paragraph that holds them."""
        if len(path) > _MAX_DEPTH:
            raise FormatError(f"{part}: nested too deeply")
        k = 0
        for b in node:
            n = local(b.tag)
            own = [*path, k]
            if n == "p":
                boxes: list = []
                self.out["blocks"].append((part, own, "paragraph", self.section if part == _MAIN else None, None, None))
                self.paragraph(part, own, b, boxes)
                k += 1
                for box in boxes:
                    own = [*path, k]
                    self.out["blocks"].append((part, own, "textbox", self.section if part == _MAIN else None, None, None))
                    self.blocks(part, box, own)
                    k += 1
                if part == _MAIN and (s := child(child(b, "pPr"), "sectPr")) is not None:
                    self.close_section(s)
                continue
            if n == "tbl":
                self.out["blocks"].append((part, own, "table", self.section if part == _MAIN else None, None, None))
                for i, row in enumerate(children(b, "tr")):
                    for j, cell in enumerate(children(row, "tc")):
                        pr = child(cell, "tcPr")
                        merge = child(pr, "vMerge")
                        self.out["table_cells"].append((
                            part, own, i, j, _int(attr(child(pr, "gridSpan"), "val")) or 1, None if merge is None else attr(merge, "val", "continue"),
                            attr(child(pr, "shd"), "fill") or None, _int(attr(child(pr, "tcW"), "w")),
                        ))
                        self.blocks(part, cell, [*own, i, j])
                k += 1
            elif n == "sdt":
                self.out["blocks"].append((part, own, "sdt", self.section if part == _MAIN else None, None, None))
                if child(b, "sdtContent") is not None:
                    self.blocks(part, child(b, "sdtContent"), own)
                k += 1
            elif n in ("ins", "del"):
                self.out["blocks"].append((part, own, n, self.section if part == _MAIN else None, attr(b, "author") or None, attr(b, "id") or None))
                self.blocks(part, b, own)
                k += 1
            elif n == "sectPr" and part == _MAIN:
                self.close_section(b)
        for ord_, m in enumerate(x for x in node if local(x.tag) == "bookmarkStart"):
            self.out["bookmarks"].append((ord_, part, attr(m, "id"), attr(m, "name")))

    def close_section(self, s) -> None:
        size, margin = child(s, "pgSz"), child(s, "pgMar")
        links = rels(self.found, _MAIN)

        def targets(name: str) -> dict[str, str]:
            got = {}
            for r in children(s, name):
                rel = links.get(attr(r, "id"))
                if rel is None or rel[1] not in self.found:
                    raise FormatError(f"{_MAIN}: {name} {attr(r, 'id')} has no part")
                got[attr(r, "type", "default")] = rel[1]
            return got

        sides = (_int(attr(margin, n)) for n in ("top", "bottom", "left", "right"))
        self.out["sections"].append((self.section, _int(attr(size, "w")), _int(attr(size, "h")), *sides, attr(size, "orient", "portrait"), targets("headerReference"), targets("footerReference")))
        self.section += 1

    def side_parts(self) -> None:
        found, out = self.found, self.out
        links = rels(found, _MAIN)
        types = {attr(o, "PartName").lstrip("/"): attr(o, "ContentType") for o in children(xml(found, "[Content_Types].xml"), "Override")} if "[Content_Types].xml" in found else {}
        for rid, (kind, target, external) in links.items():
            if kind == "hyperlink":
                out["hyperlinks"].append((rid, target, external))
            elif kind == "image":
                if not external and target not in found:
                    raise FormatError(f"image {rid} has no part {target}")
                if not external:
                    self.used.add(target)
                    out["images"].append((rid, target, types.get(target, ""), found[target]))
            elif kind in ("header", "footer") and target in found:
                self.used.add(target)
                self.blocks(target, xml(found, target), [])
        for s in children(xml(found, "word/styles.xml"), "style") if "word/styles.xml" in found else []:
            p = child(s, "rPr")
            out["styles"].append((
                attr(s, "styleId"), attr(s, "type"), attr(child(s, "name"), "val"), attr(child(s, "basedOn"), "val") or None, attr(s, "default") in ("1", "true"),
                flag(child(p, "b")), flag(child(p, "i")), _int(attr(child(p, "sz"), "val")), attr(child(p, "color"), "val") or None,
            ))
        if "word/numbering.xml" in found:
            root = xml(found, "word/numbering.xml")
            abstract = {attr(a, "abstractNumId"): a for a in children(root, "abstractNum")}
            for num in children(root, "num"):
                levels = {attr(v, "ilvl"): v for v in children(abstract.get(attr(child(num, "abstractNumId"), "val")), "lvl")}
                starts: dict[str, str] = {}
                for o in children(num, "lvlOverride"):
                    if child(o, "lvl") is not None:
                        levels[attr(o, "ilvl")] = child(o, "lvl")
                    if child(o, "startOverride") is not None:
                        starts[attr(o, "ilvl")] = attr(child(o, "startOverride"), "val")
                for key, v in levels.items():
                    start = starts.get(key) or attr(child(v, "start"), "val", "1")
                    out["numbering"].append((_int(attr(num, "numId")), _int(key), attr(child(v, "numFmt"), "val"), attr(child(v, "lvlText"), "val"), _int(start)))
        for kind, name in (("footnote", "word/footnotes.xml"), ("endnote", "word/endnotes.xml")):
            for n in children(xml(found, name), kind) if name in found else []:
                if (_int(attr(n, "id")) or 0) > 0:
                    out["notes"].append((kind, _int(attr(n, "id")), self.plain(n)))
        for c in children(xml(found, "word/comments.xml"), "comment") if "word/comments.xml" in found else []:
            out["comments"].append((_int(attr(c, "id")), attr(c, "author"), attr(c, "date"), attr(c, "initials"), self.plain(c)))
        core = {local(e.tag): e.text or "" for e in xml(found, "docProps/core.xml")} if "docProps/core.xml" in found else {}
        app = {local(e.tag): e.text or "" for e in xml(found, "docProps/app.xml")} if "docProps/app.xml" in found else {}
        keys = ("title", "creator", "lastModifiedBy", "created", "modified", "subject", "keywords", "description", "category")
        out["documents"].append((*(core.get(k) for k in keys), app.get("Application"), _int(app.get("Pages", "")), _int(app.get("Words", ""))))
        for p in children(xml(found, "docProps/custom.xml"), "property") if "docProps/custom.xml" in found else []:
            value = next(iter(p), None)
            out["custom_props"].append((attr(p, "name"), "" if value is None else local(value.tag), text_of(value)))
        modelled = {_MAIN, "word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml", "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"} | self.used
        out["raw_parts"] = [(n, c) for n, c in found.items() if n not in modelled]

    def plain(self, node) -> str:
        return "\n".join("".join(self.run_text(r)[0] for r in p.iter() if local(r.tag) == "r") for p in node.iter() if local(p.tag) == "p")


def _paragraph_runs(out: dict[str, list[tuple]]) -> list[tuple]:
    """Every paragraph with its runs, so that a text needs no join of the two tables; one without runs is an empty run."""
    held: dict[tuple, list[tuple]] = {(p[0], *p[1]): [] for p in out["paragraphs"]}
    for part, path, _, index, kind, text, deleted, *_ in out["runs"]:
        held[part, *path].append((part, path, index, kind, text, deleted))
    return [row for p in out["paragraphs"] for row in held[p[0], *p[1]] or [(p[0], p[1], None, "run", None, None)]]


def parse(data: bytes) -> dict[str, list[tuple]]:
    """All tables of a document."""
    found = parts(data)
    root = xml(found, _MAIN)
    body = child(root, "body")
    if local(root.tag) != "document" or body is None:
        raise FormatError(f"{_MAIN}: no document with a body")
    reader = _Reader(found)
    reader.blocks(_MAIN, body, [])
    reader.side_parts()
    reader.out["paragraph_runs"] = _paragraph_runs(reader.out)
    return reader.out


def flat_text(data: bytes, view: str = "accept") -> str:
    """The body's text: shown runs of each paragraph, paragraphs by line feeds, tables cell by cell."""
    from ..operators.documents import DELETED, MOVED_FROM, VIEWS

    t = parse(data)
    texts: dict[tuple, str] = {tuple(p[1]): "" for p in t["paragraphs"] if p[0] == _MAIN}
    gone = {tuple(b[1]) for b in t["blocks"] if b[2] == ("del" if view == "accept" else "ins")}
    for part, path, _, _, kind, text, deleted, *_ in t["runs"]:
        if part == _MAIN and (kind in VIEWS[view] or kind == "field"):
            texts[tuple(path)] += deleted if kind in (DELETED, MOVED_FROM) and view == "reject" else text
    keep = [p for p in texts if not any(p[: len(g)] == g for g in gone)]
    return "\n".join(texts[p] for p in sorted(keep))
