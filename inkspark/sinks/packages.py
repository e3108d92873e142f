"""Writers: ZIP archives, word-processing documents and spreadsheets' containers."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from ..sources.package import FormatError, safe_name

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def zip_bytes(entries: list[tuple[str, bytes]], stored: frozenset[str] = frozenset()) -> bytes:
    """An archive of (name, content), deflated but for the stored ones; equal input gives equal bytes."""
    seen: set[str] = set()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries:
            if not safe_name(name) or name in seen:
                raise FormatError(f"bad or repeated entry name {name!r}")
            seen.add(name)
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


@dataclass
class TextRun:
    text: str = ""
    bold: bool = False
    italic: bool = False
    size_pt: float = 0
    color: str = ""
    style: str = ""
    link: str = ""  # relationship id
    footnote: int = 0
    image: str = ""  # relationship id
    width_emu: int = 914400
    height_emu: int = 914400


@dataclass
class Paragraph:
    runs: list[TextRun] = field(default_factory=list)
    style: str = ""
    align: str = ""
    num_id: int = 0
    level: int = 0


@dataclass
class Table:
    rows: list[list[list[Paragraph]]]
    style: str = "TableGrid"


@dataclass
class DocxBuilder:
    """A document under construction; :meth:`to_bytes` checks references and writes the package."""

    title: str = ""
    author: str = ""
    blocks: list[Paragraph | Table] = field(default_factory=list)
    links: dict[str, str] = field(default_factory=dict)
    images: dict[str, tuple[str, bytes]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    comments: list[tuple[str, str]] = field(default_factory=list)
    headers: dict[str, list[Paragraph]] = field(default_factory=dict)
    footers: dict[str, list[Paragraph]] = field(default_factory=dict)
    numbering: dict[int, list[tuple[str, str]]] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)
    page: tuple[int, int] = (11906, 16838)
    raw_parts: dict[str, bytes] = field(default_factory=dict)

    def paragraph(self, text: str = "", style: str = "", align: str = "") -> Paragraph:
        p = Paragraph([TextRun(text)] if text else [], style, align)
        self.blocks.append(p)
        return p

    def table(self, rows: list[list[str]], style: str = "TableGrid") -> Table:
        t = Table([[[Paragraph([TextRun(c)] if c else [])] for c in r] for r in rows], style)
        self.blocks.append(t)
        return t

    def _free_id(self) -> str:
        used = {*self.links, *self.images}
        return next(f"rId{k}" for k in range(1, len(used) + 2) if f"rId{k}" not in used)

    def hyperlink(self, text: str, target: str) -> TextRun:
        rid = self._free_id()
        self.links[rid] = target
        return TextRun(text, link=rid)

    def image(self, data: bytes, extension: str = "png") -> TextRun:
        rid = self._free_id()
        self.images[rid] = (extension, data)
        return TextRun(image=rid)

    def footnote(self, text: str) -> TextRun:
        self.notes.append(text)
        return TextRun(footnote=len(self.notes))

    def comment(self, author: str, text: str) -> int:
        self.comments.append((author, text))
        return len(self.comments) - 1

    def _run(self, r: TextRun) -> str:
        props = "".join((
            f"<w:rStyle w:val={quoteattr(r.style)}/>" if r.style else "", "<w:b/>" if r.bold else "", "<w:i/>" if r.italic else "",
            f"<w:color w:val={quoteattr(r.color)}/>" if r.color else "", f'<w:sz w:val="{round(2 * r.size_pt)}"/>' if r.size_pt else "",
        ))
        body = []
        for k, line in enumerate(r.text.split("\n")):
            if k:
                body.append("<w:br/>")
            for j, piece in enumerate(line.split("\t")):
                if j:
                    body.append("<w:tab/>")
                if piece:
                    body.append(f'<w:t xml:space="preserve">{escape(piece)}</w:t>')
        if r.footnote:
            body.append(f'<w:footnoteReference w:id="{r.footnote}"/>')
        if r.image:
            body.append(
                '<w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing">'
                f'<wp:extent cx="{r.width_emu}" cy="{r.height_emu}"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData>'
                f'<pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:blipFill><a:blip r:embed={quoteattr(r.image)}/></pic:blipFill></pic:pic>'
                "</a:graphicData></a:graphic></wp:inline></w:drawing>"
            )
        xml = f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{''.join(body)}</w:r>"
        return f"<w:hyperlink r:id={quoteattr(r.link)}>{xml}</w:hyperlink>" if r.link else xml

    def _paragraph(self, p: Paragraph) -> str:
        props = "".join((
            f"<w:pStyle w:val={quoteattr(p.style)}/>" if p.style else "",
            f'<w:numPr><w:ilvl w:val="{p.level}"/><w:numId w:val="{p.num_id}"/></w:numPr>' if p.num_id else "", f"<w:jc w:val={quoteattr(p.align)}/>" if p.align else "",
        ))
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(map(self._run, p.runs))}</w:p>"

    def _block(self, b: Paragraph | Table) -> str:
        if isinstance(b, Paragraph):
            return self._paragraph(b)
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(map(self._paragraph, c)) or '<w:p/>'}</w:tc>" for c in row) + "</w:tr>" for row in b.rows)
        return f"<w:tbl><w:tblPr><w:tblStyle w:val={quoteattr(b.style)}/></w:tblPr>{rows}</w:tbl>"

    def _all(self) -> list[Paragraph]:
        out: list[Paragraph] = []
        for b in self.blocks:
            out += [b] if isinstance(b, Paragraph) else [p for row in b.rows for c in row for p in c]
        return out + [p for part in (*self.headers.values(), *self.footers.values()) for p in part]

    def validate(self) -> None:
        for p in self._all():
            if p.num_id and p.num_id not in self.numbering:
                raise FormatError(f"list {p.num_id} has no definition")
            for r in p.runs:
                if r.link and r.link not in self.links or r.image and r.image not in self.images:
                    raise FormatError(f"unknown relationship {r.link or r.image}")
                if r.footnote > len(self.notes):
                    raise FormatError(f"unknown footnote {r.footnote}")
        if set(self.links) & set(self.images):
            raise FormatError("a relationship id is used twice")

    def to_bytes(self) -> bytes:
        self.validate()
        rels, types, parts = [], [], []
        rel = lambda rid, kind, target, external=False: rels.append(f"<Relationship Id={quoteattr(rid)} Type=\"{_REL}/{kind}\" Target={quoteattr(target)}{' TargetMode=\"External\"' if external else ''}/>")
        for rid, target in self.links.items():
            rel(rid, "hyperlink", target, True)
        for rid, (extension, data) in self.images.items():
            rel(rid, "image", f"media/{rid}.{extension}")
            parts.append((f"word/media/{rid}.{extension}", data))
        refs = []
        for what, held in (("header", self.headers), ("footer", self.footers)):
            for k, (kind, paragraphs) in enumerate(held.items(), 1):
                name = f"{what}{k}.xml"
                rel(f"{what}{k}", what, name)
                refs.append(f'<w:{what}Reference w:type="{kind}" r:id="{what}{k}"/>')
                parts.append((f"word/{name}", f"{_HEAD}<w:{'hdr' if what == 'header' else 'ftr'} {_W}>{''.join(map(self._paragraph, paragraphs))}</w:{'hdr' if what == 'header' else 'ftr'}>".encode()))
                types.append((f"/word/{name}", f"{_TYPE}.{what}+xml"))
        if self.notes:
            notes = "".join(f'<w:footnote w:id="{k}"><w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p></w:footnote>' for k, t in enumerate(self.notes, 1))
            parts.append(("word/footnotes.xml", f"{_HEAD}<w:footnotes {_W}>{notes}</w:footnotes>".encode()))
            rel("footnotes", "footnotes", "footnotes.xml")
        if self.comments:
            body = "".join(f'<w:comment w:id="{k}" w:author={quoteattr(a)}><w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p></w:comment>' for k, (a, t) in enumerate(self.comments))
            parts.append(("word/comments.xml", f"{_HEAD}<w:comments {_W}>{body}</w:comments>".encode()))
            rel("comments", "comments", "comments.xml")
        if self.styles:
            body = "".join(f'<w:style w:type="paragraph" w:styleId={quoteattr(k)}><w:name w:val={quoteattr(v)}/></w:style>' for k, v in self.styles.items())
            parts.append(("word/styles.xml", f"{_HEAD}<w:styles {_W}>{body}</w:styles>".encode()))
            rel("styles", "styles", "styles.xml")
        if self.numbering:
            level = lambda levels: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val={quoteattr(f)}/><w:lvlText w:val={quoteattr(t)}/></w:lvl>' for i, (f, t) in enumerate(levels))
            body = "".join(f'<w:abstractNum w:abstractNumId="{k}">{level(v)}</w:abstractNum>' for k, v in self.numbering.items())
            body += "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in self.numbering)
            parts.append(("word/numbering.xml", f"{_HEAD}<w:numbering {_W}>{body}</w:numbering>".encode()))
            rel("numbering", "numbering", "numbering.xml")
        section = f'<w:sectPr>{"".join(refs)}<w:pgSz w:w="{self.page[0]}" w:h="{self.page[1]}"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
        document = f"{_HEAD}<w:document {_W}><w:body>{''.join(map(self._block, self.blocks))}{section}</w:body></w:document>".encode()
        core = (
            f'{_HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
            f"<dc:title>{escape(self.title)}</dc:title><dc:creator>{escape(self.author)}</dc:creator></cp:coreProperties>"
        ).encode()
        overrides = "".join(f'<Override PartName="{n}" ContentType="{t}"/>' for n, t in [("/word/document.xml", f"{_TYPE}.document.main+xml"), *types])
        defaults = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in [("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *((e, f"image/{e}") for e in sorted({e for e, _ in self.images.values()}))])
        own = [
            ("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{defaults}{overrides}</Types>'.encode()),
            ("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>'.encode()),
            ("word/document.xml", document), ("docProps/core.xml", core),
            ("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>'.encode()),
            *parts,
        ]
        names = {n for n, _ in own}
        return zip_bytes(own + [(n, c) for n, c in self.raw_parts.items() if n not in names])
