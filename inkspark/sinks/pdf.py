"""PDF writers: flowing text, copies of pages (merge, extract), incremental updates."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from ..sources.cos import Document, Name, Ref, Stream
from ..sources.package import FormatError
from ..sources.pdf import pages

#: Widths of Helvetica from the space to the tilde, in thousandths.
_WIDTHS = [int(w) for w in (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 "
    "722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
).split()]




class _Widths(dict):
    def __missing__(self, char: str) -> int:  # all others are as wide as a figure
        return 556


_WIDTH_OF = _Widths((chr(32 + k), w) for k, w in enumerate(_WIDTHS))


def _units(text: str) -> int:
    """A text's width in thousandths of its size."""
    return sum(map(_WIDTH_OF.__getitem__, text))


def text_width(text: str, size: float) -> float:
    return _units(text) * size / 1000


def wrapped(text: str, size: float, width: float) -> list[str]:
    """Greedy lines; spaces collapse, and a word that is too wide stands alone.

    Each word is measured once: a line's width is the sum of whole thousandths so far."""
    lines: list[str] = []
    held: list[str] = []
    units = 0
    for word in text.split():
        own = _units(word)
        longer = units + _WIDTHS[0] + own if held else own
        if held and longer * size / 1000 > width + 1e-6:
            lines.append(" ".join(held))
            held, units = [word], own
        else:
            held.append(word)
            units = longer
    return lines + [" ".join(held)] if held else lines


class Written(bytes):
    """An object that is in its written form already."""


def serialized(value) -> bytes:
    """An object's bytes; dictionaries keep their order."""
    if value is None:
        return b"null"
    if isinstance(value, Written):
        return value
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in str(value).encode("utf-8", "surrogateescape"))
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return (f"{value:.4f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(map(serialized, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialized(Name(k)) + b" " + serialized(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialized({**value.info, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise FormatError(f"cannot write {type(value).__name__}")


_FONT = Written(serialized({
    "Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "LastChar": 126, "Widths": [float(w) for w in _WIDTHS],
}))


def build(objects: dict[int, object], trailer: dict) -> bytes:
    """A file of objects by number, with a classic cross-reference table; unused numbers are free."""
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    offsets = {}
    for num in sorted(objects):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + serialized(objects[num]) + b"\nendobj\n"
    size = max(objects, default=0) + 1
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for num in range(1, size):
        out += b"%010d 00000 n \n" % offsets[num] if num in offsets else b"0000000000 00000 f \n"
    out += b"trailer\n" + serialized({**trailer, "Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def flow(paragraphs: Sequence[tuple[str, float]], page: tuple[float, float] = (595.0, 842.0), margin: float = 72.0, title: str = "") -> bytes:
    """Paragraphs (text, size) set in one column over as many pages as they need; equal input gives equal bytes."""
    contents: list[list[bytes]] = [[]]
    y = page[1] - margin
    width = page[0] - 2 * margin
    left = serialized(margin)
    for text, size in paragraphs:
        if not text.strip():
            y -= 0.6 * size
            continue
        font = serialized(float(size))
        for line in wrapped(text, size, width):
            if y - size < margin + 0.2 * size:
                contents.append([])
                y = page[1] - margin
            y -= 1.2 * size
            raw = line.encode("cp1252", "replace")
            contents[-1].append(b"BT /F1 %s Tf %s %s Td %s Tj ET" % (font, left, serialized(y), serialized(raw)))
        y -= 0.4 * size
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    objects[3] = _FONT
    kids = []
    for k, lines in enumerate(contents):
        own, body = 4 + 2 * k, zlib.compress(b"\n".join(lines), 9)
        objects[own] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, *map(float, page)], "Resources": {"Font": {"F1": Ref(3, 0)}}, "Contents": Ref(own + 1, 0)}
        objects[own + 1] = Stream({"Filter": Name("FlateDecode")}, body)
        kids.append(Ref(own, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    trailer: dict = {"Root": Ref(1, 0)}
    if title:
        objects[4 + 2 * len(contents)] = {"Title": b"\xfe\xff" + title.encode("utf-16-be")}
        trailer["Info"] = Ref(4 + 2 * len(contents), 0)
    return build(objects, trailer)


def copied(sources: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The listed pages (from 0) of the sources behind one another; a page named twice is copied twice.

    Inherited boxes, resources and rotation become the page's own; stream data is not touched; encrypted files are refused.
    """
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    kids: list[Ref] = []
    for data, wanted in sources:
        doc = Document.open(data)
        if "Encrypt" in doc.trailer:
            raise FormatError("an encrypted file cannot be copied from")
        leaves = pages(doc)
        for index in wanted:
            if not 0 <= index < len(leaves):
                raise FormatError(f"no page {index}")
            leaf = leaves[index]
            moved: dict[int, Ref] = {}

            def clone(value, moved=moved, doc=doc):
                if isinstance(value, Ref):
                    if value.num not in moved:
                        held = doc.resolve(value)
                        if isinstance(held, dict) and held.get("Type") in ("Page", "Pages", "Catalog"):
                            return None
                        moved[value.num] = Ref(max(objects) + 1, 0)
                        objects[moved[value.num].num] = None
                        objects[moved[value.num].num] = clone(held)
                    return moved[value.num]
                if isinstance(value, list):
                    return [clone(v) for v in value]
                if isinstance(value, dict):
                    return {k: clone(v) for k, v in value.items()}
                if isinstance(value, Stream):
                    return Stream({k: clone(v) for k, v in value.info.items() if k != "Length"}, value.raw)
                return value

            objects.setdefault(2, None)
            num = max(objects) + 1
            objects[num] = None
            own = {k: clone(v) for k, v in leaf.info.items() if k not in ("Parent", "MediaBox", "Resources", "Rotate", "StructParents", "B")}
            objects[num] = {"Type": Name("Page"), "Parent": Ref(2, 0), **{k: v for k, v in own.items() if k != "Type"}, "MediaBox": leaf.box, "Resources": clone(leaf.resources), "Rotate": leaf.rotate}
            kids.append(Ref(num, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return build(objects, {"Root": Ref(1, 0)})


def merged(files: Sequence[bytes]) -> bytes:
    """All pages of several files."""
    return copied([(f, range(len(pages(Document.open(f))))) for f in files])


def updated(data: bytes, changes: dict[int, object]) -> bytes:
    """The file with new versions of objects appended; what was there stays byte for byte."""
    if not changes:
        raise FormatError("nothing to update")
    doc = Document.open(data)
    if doc.recovered or "Encrypt" in doc.trailer:
        raise FormatError("only a sound, unencrypted file can be updated")
    start = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    offsets = {}
    for num in sorted(changes):
        gen = doc.offsets.get(num, (0, 0))[1]
        offsets[num] = (len(out), gen)
        out += b"%d %d obj\n" % (num, gen) + serialized(changes[num]) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    numbers = sorted(offsets)
    while numbers:
        run = [numbers[0]]
        while len(run) < len(numbers) and numbers[len(run)] == run[-1] + 1:
            run.append(numbers[len(run)])
        numbers = numbers[len(run) :]
        out += b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d %05d n \n" % offsets[n] for n in run)
    size = max(max(doc.offsets, default=0), max(doc.packed, default=0), max(changes)) + 1
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID")}
    return bytes(out) + b"trailer\n" + serialized({**trailer, "Size": size, "Prev": start}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
