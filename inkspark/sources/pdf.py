"""PDF documents: pages, text runs, outline, labels, annotations, form fields, attachments, structure and images as rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from .cos import MAX_DEPTH, MAX_PAGES, Document, Lexer, Name, Op, Ref, Stream, decoded, plain, text_string
from .package import FormatError

TABLES = {
    "documents": "version string, pages int, encrypted boolean, recovered boolean, notes array<string>, title string, author string, subject string, keywords string, creator string, producer string, created string, modified string",
    "pages": "page int, width double, height double, rotate int, obj_num int",
    "objects": "obj_num int, kind string, type string, n_bytes long",
    "runs": "page int, run_idx int, text string, x double, y double, size double, font_name string, w double, vert boolean",
    "outline": "node_id int, parent_id int, ord int, depth int, title string, dest string, page_index int, kind string, uri string, open boolean",
    "labels": "ord int, start int, style string, prefix string, first int",
    "annots": "page int, ord int, subtype string, x1 double, y1 double, x2 double, y2 double, contents string, title string, uri string, dest_page int, name string, modified string, flags int",
    "fields": "ord int, name string, kind string, value string, flags int, max_len int, options array<string>, states array<string>, read_only boolean",
    "attachments": "ord int, name string, display_name string, description string, mime string, size long, data binary",
    "signatures": "ord int, field string, filter string, sub_filter string, name string, signed string, reason string, byte_range array<long>, covers_file boolean",
    "struct": "node_id int, parent_id int, ord int, depth int, type string, title string, alt string, actual_text string, page_index int",
    "images": "page int, draw_idx int, name string, width int, height int, bits int, color_space string, filter string, x double, y double, w double, h double, data binary",
}
#: Names of glyphs that are not their own letter.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "Euro": "€", "germandbls": "ß", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü",
    "Adieresis": "Ä", "Odieresis": "Ö", "Udieresis": "Ü", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "minus": "−", "multiply": "×", "degree": "°", "copyright": "©", "registered": "®", "section": "§", "nbspace": " ",
}
Matrix = tuple[float, float, float, float, float, float]
_UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def concat(a: Matrix, b: Matrix) -> Matrix:
    """``a`` applied before ``b``."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


@dataclass
class Page:
    info: dict
    box: list[float]
    rotate: int
    resources: dict
    num: int


def pages(doc: Document) -> list[Page]:
    """Leaves of the page tree with what they inherit, at most the limit."""
    out: list[Page] = []
    root = doc.resolve(doc.trailer.get("Root")) or {}

    def walk(ref, inherited: dict, depth: int, seen: frozenset) -> None:
        node = doc.resolve(ref)
        key = ref.num if isinstance(ref, Ref) else id(node)
        if depth > MAX_DEPTH or key in seen:
            raise FormatError("the page tree is too deep or has a cycle")
        if not isinstance(node, dict):
            return
        own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in node}
        kids = doc.resolve(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                walk(kid, own, depth + 1, seen | {key})
            return
        if len(out) >= MAX_PAGES:
            raise FormatError("too many pages")
        box = [float(doc.resolve(v)) for v in doc.resolve(own.get("MediaBox")) or [0, 0, 612, 792]]
        out.append(Page(node, box, int(doc.resolve(own.get("Rotate")) or 0), doc.resolve(own.get("Resources")) or {}, ref.num if isinstance(ref, Ref) else 0))

    walk(root.get("Pages"), {}, 0, frozenset())
    return out


#: A word, a name without escapes, or a string in hex digits alone; all else is left to the lexer.
_SIMPLE = re.compile(rb"[\0\t\n\f\r ]*(?:([^\0\t\n\f\r ()<>\[\]{}/%]+)|/([^\0\t\n\f\r ()<>\[\]{}/%#]*)(?![^\0\t\n\f\r ()<>\[\]{}/%])|<([0-9A-Fa-f]*)>)")


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream; what cannot be read is passed over."""
    lexer, out, held = Lexer(data), [], []
    words: dict[bytes, object] = {}
    while len(out) < 100_000:
        found = _SIMPLE.match(data, lexer.at)
        if found is not None:
            lexer.at = found.end()
            word, name, digits = found.groups()
            if word is not None:
                value = words[word] if word in words else words.setdefault(word, plain(word))
            elif name is not None:
                value = Name(name.decode("utf-8", "surrogateescape"))
            else:
                value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            try:
                value = lexer.value()
            except EOFError:
                break
            except FormatError:
                lexer.at += 1
                continue
        if not isinstance(value, Op):
            held.append(value)
            continue
        if value.name == "BI":
            end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(data, lexer.at)
            lexer.at = end.end() if end else len(data)
        out.append((value.name, held))
        held = []
    return out


def cmap(data: bytes) -> tuple[dict[int, str], set[int]]:
    """Code to text of a ToUnicode map, and the lengths of its codes in bytes."""
    out: dict[int, str] = {}
    widths: set[int] = set()
    word = lambda raw: raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")
    held: list = []
    for name, operands in operations(data):
        held = operands
        if name == "endcodespacerange":
            widths |= {len(v) for v in held if isinstance(v, bytes)}
        elif name == "endbfchar":
            for code, text in zip(held[::2], held[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(text, bytes):
                    out[int.from_bytes(code, "big")] = word(text)
        elif name == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(b - a + 1, 65536)):
                    if isinstance(to, list):
                        if k < len(to):
                            out[a + k] = word(to[k])
                    else:
                        text = word(to)
                        out[a + k] = text[:-1] + chr(ord(text[-1]) + k) if text else ""
    return out, widths or {1}


class _Codes(dict):
    """Values of the codes met so far."""

    def __init__(self, of: Callable[[int], object]):
        super().__init__()
        self.of = of

    def __missing__(self, code: int):
        self[code] = value = self.of(code)
        return value


@dataclass
class Font:
    name: str = ""
    composite: bool = False
    vertical: bool = False
    texts: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 500.0
    names: dict[int, str] = field(default_factory=dict)
    encoding: str = ""
    pieces: _Codes = field(init=False, repr=False, compare=False)
    steps: dict[tuple, _Codes] = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.pieces = _Codes(self.text)

    def advances(self, size: float, char: float, word: float, scale: float) -> _Codes:
        """How far each code moves on in a state of the text."""
        key = (size, char, word, scale)
        if key not in self.steps:
            self.steps[key] = _Codes(lambda code: (self.widths.get(code, self.default) * size / 1000 + char) * scale + (word * scale if self.pieces[code] == " " else 0.0))
        return self.steps[key]

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)] if self.composite else list(raw)

    def text(self, code: int) -> str:
        if code in self.texts:
            return self.texts[code]
        if self.composite:
            return "�"
        if code in self.names:
            name = self.names[code]
            if name in _GLYPHS:
                return _GLYPHS[name]
            if len(name) == 1:
                return name
            found = re.fullmatch(r"(?:uni|u)([0-9A-Fa-f]{4,6})", name)
            return chr(int(found[1], 16)) if found else "�"
        kind = {"MacRomanEncoding": "mac-roman"}.get(self.encoding, "cp1252")
        if self.encoding:
            return bytes([code]).decode(kind, "replace")
        return chr(code) if 32 <= code < 127 else bytes([code]).decode("cp1252", "replace") if code > 127 else "�"


def load_font(doc: Document, info: dict) -> Font:
    font = Font(str(doc.resolve(info.get("BaseFont")) or ""))
    font.composite = info.get("Subtype") == "Type0"
    to_unicode = doc.resolve(info.get("ToUnicode"))
    if isinstance(to_unicode, Stream):
        font.texts = cmap(doc.content(to_unicode))[0]
    encoding = doc.resolve(info.get("Encoding"))
    if font.composite:
        font.vertical = str(encoding).endswith("-V")
        child = doc.resolve((doc.resolve(info.get("DescendantFonts")) or [{}])[0]) or {}
        font.default = float(doc.resolve(child.get("DW")) or 1000)
        items = doc.resolve(child.get("W")) or []
        k = 0
        while k + 1 < len(items):
            first, second = doc.resolve(items[k]), doc.resolve(items[k + 1])
            if isinstance(second, list):
                font.widths |= {first + i: float(doc.resolve(w)) for i, w in enumerate(second)}
                k += 2
            else:
                font.widths |= {c: float(doc.resolve(items[k + 2])) for c in range(first, min(second, first + 65535) + 1)}
                k += 3
        return font
    if isinstance(encoding, dict):
        font.encoding = str(encoding.get("BaseEncoding", ""))
        code = 0
        for item in doc.resolve(encoding.get("Differences")) or []:
            if isinstance(item, int):
                code = item
            else:
                font.names[code] = str(item)
                code += 1
    elif encoding is not None:
        font.encoding = str(encoding)
    first = doc.resolve(info.get("FirstChar")) or 0
    font.widths = {first + k: float(doc.resolve(w) or 0) for k, w in enumerate(doc.resolve(info.get("Widths")) or [])}
    return font


@dataclass
class State:
    ctm: Matrix = _UNIT
    font: Font = field(default_factory=Font)
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


def page_content(doc: Document, page: Page) -> bytes:
    content = doc.resolve(page.info.get("Contents"))
    streams = content if isinstance(content, list) else [content]
    return b"\n".join(doc.content(s) for s in map(doc.resolve, streams) if isinstance(s, Stream))


def extract(doc: Document, page: Page) -> tuple[list[tuple], list[tuple]]:
    """Text runs (text, x, y, size, font, width, vertical) and drawn images of a page, forms expanded."""
    runs: list[tuple] = []
    images: list[tuple] = []
    fonts: dict[int, Font] = {}
    unknown: dict = {}  # stands for fonts that are not there; it lives on, so no other font gets its id

    def walk(data: bytes, resources: dict, state: State, box: list[float] | None, depth: int) -> None:
        stack: list[State] = []
        tm = line = _UNIT

        def show(raw: bytes) -> None:
            nonlocal tm
            codes = state.font.codes(raw)
            text = "".join(map(state.font.pieces.__getitem__, codes))
            steps = state.font.advances(state.size, state.char, state.word, state.scale)
            advance = reduce(add, map(steps.__getitem__, codes), 0.0)  # term by term: sum() would round otherwise
            at = concat((1, 0, 0, 1, 0, state.rise), concat(tm, state.ctm))
            full = concat(tm, state.ctm)
            size = state.size * (full[2] ** 2 + full[3] ** 2) ** 0.5
            stretch = (full[0] ** 2 + full[1] ** 2) ** 0.5
            if codes and (box is None or box[0] <= at[4] <= box[2] and box[1] <= at[5] <= box[3]):
                runs.append((text, at[4], at[5], size, state.font.name, advance * stretch, state.font.vertical))
            tm = concat((1, 0, 0, 1, advance, 0), tm)

        def step(tx: float, ty: float) -> None:
            nonlocal tm, line
            line = tm = concat((1, 0, 0, 1, tx, ty), line)

        for name, args in operations(data):
            try:
                if name == "q":
                    stack.append(replace(state))
                elif name == "Q":
                    state = stack.pop() if stack else state
                elif name == "cm":
                    state.ctm = concat(tuple(map(float, args[:6])), state.ctm)
                elif name == "BT":
                    tm = line = _UNIT
                elif name == "Td":
                    step(args[0], args[1])
                elif name == "TD":
                    state.leading = -args[1]
                    step(args[0], args[1])
                elif name == "Tm":
                    tm = line = tuple(map(float, args[:6]))
                elif name == "T*":
                    step(0, -state.leading)
                elif name == "Tf":
                    info = doc.resolve((doc.resolve(resources.get("Font")) or {}).get(str(args[0]))) or unknown
                    if id(info) not in fonts:
                        fonts[id(info)] = load_font(doc, info)
                    state.font, state.size = fonts[id(info)], float(args[1])
                elif name == "Tc":
                    state.char = float(args[0])
                elif name == "Tw":
                    state.word = float(args[0])
                elif name == "Tz":
                    state.scale = args[0] / 100
                elif name == "TL":
                    state.leading = float(args[0])
                elif name == "Ts":
                    state.rise = float(args[0])
                elif name == "Tj":
                    show(args[0])
                elif name == "TJ":
                    for item in args[0]:
                        if isinstance(item, bytes):
                            show(item)
                        elif isinstance(item, (int, float)):
                            tm = concat((1, 0, 0, 1, -item * state.size * state.scale / 1000, 0), tm)
                elif name in ("'", '"'):
                    if name == '"':
                        state.word, state.char = float(args[0]), float(args[1])
                    step(0, -state.leading)
                    show(args[-1])
                elif name == "Do":
                    held = doc.resolve((doc.resolve(resources.get("XObject")) or {}).get(str(args[0])))
                    if not isinstance(held, Stream):
                        continue
                    if held.info.get("Subtype") == "Form" and depth < 12:
                        inner = replace(state)
                        matrix = doc.resolve(held.info.get("Matrix"))
                        if matrix:
                            inner.ctm = concat(tuple(float(doc.resolve(v)) for v in matrix), inner.ctm)
                        edge = doc.resolve(held.info.get("BBox"))
                        clip = box
                        if edge:
                            a, b, c, d = (float(doc.resolve(v)) for v in edge)
                            corners = [concat((1, 0, 0, 1, x, y), inner.ctm)[4:] for x in (a, c) for y in (b, d)]
                            clip = [min(p[0] for p in corners), min(p[1] for p in corners), max(p[0] for p in corners), max(p[1] for p in corners)]
                        walk(doc.content(held), {**resources, **(doc.resolve(held.info.get("Resources")) or {})}, inner, clip, depth + 1)
                    elif held.info.get("Subtype") == "Image":
                        m = state.ctm
                        filters = doc.resolve(held.info.get("Filter"))
                        last = str(filters[-1] if isinstance(filters, list) and filters else filters or "")
                        space = doc.resolve(held.info.get("ColorSpace"))
                        images.append((
                            str(args[0]), doc.resolve(held.info.get("Width")), doc.resolve(held.info.get("Height")), doc.resolve(held.info.get("BitsPerComponent")),
                            str(space[0] if isinstance(space, list) and space else space or ""), last, m[4], m[5], abs(m[0]) + abs(m[2]), abs(m[1]) + abs(m[3]), doc.content(held),
                        ))
            except (IndexError, TypeError, ValueError):
                continue  # an operator with wrong operands

    walk(page_content(doc, page), page.resources, State(), None, 0)
    return runs, images


def name_tree(doc: Document, ref, depth: int = 0) -> list[tuple[bytes, object]]:
    """Pairs of a name tree in tree order."""
    node = doc.resolve(ref)
    if depth > MAX_DEPTH:
        raise FormatError("a name tree is too deep")
    if not isinstance(node, dict):
        return []
    names = doc.resolve(node.get("Names")) or []
    if len(names) % 2:
        raise FormatError("a name tree does not hold pairs")
    out = list(zip(names[::2], names[1::2], strict=True))
    for kid in doc.resolve(node.get("Kids")) or []:
        out += name_tree(doc, kid, depth + 1)
    return out


class _Reader:
    def __init__(self, data: bytes, password: str):
        self.doc = Document.open(data, password)
        self.pages = pages(self.doc)
        self.index = {p.num: k for k, p in enumerate(self.pages) if p.num}
        self.root = self.doc.resolve(self.doc.trailer.get("Root")) or {}
        names = self.doc.resolve(self.root.get("Names")) or {}
        self.dests = {bytes(k): v for k, v in name_tree(self.doc, names.get("Dests")) if isinstance(k, bytes)} if "Dests" in names else {}
        self.files = name_tree(self.doc, names.get("EmbeddedFiles")) if "EmbeddedFiles" in names else []

    def get(self, node: dict, key: str):
        return self.doc.resolve(node.get(key))

    def dest_page(self, dest) -> tuple[str, int]:
        """(name, page index) of a destination; -1 if it leads to no page."""
        dest = self.doc.resolve(dest)
        name = ""
        if isinstance(dest, (bytes, Name)):
            name = text_string(dest)
            raw = dest if isinstance(dest, bytes) else str(dest).encode()
            dest = self.doc.resolve(self.dests.get(raw))
            if dest is None:
                dest = self.doc.resolve((self.get(self.root, "Dests") or {}).get(name))
        if isinstance(dest, dict):
            dest = self.get(dest, "D")
        if isinstance(dest, list) and dest:
            return name, self.index.get(dest[0].num, -1) if isinstance(dest[0], Ref) else dest[0] if isinstance(dest[0], int) else -1
        return name, -1

    def action(self, node: dict) -> tuple[str, str, int, str]:
        """(kind, dest name, page index, uri) of a node's destination or action."""
        if "Dest" in node:
            return ("goto", *self.dest_page(node["Dest"]), "")
        act = self.get(node, "A")
        if isinstance(act, dict):
            kind = str(act.get("S", ""))
            if kind == "GoTo":
                return ("goto", *self.dest_page(act.get("D")), "")
            if kind == "URI":
                return "uri", "", -1, text_string(self.get(act, "URI"))
            return kind.lower(), "", -1, ""
        return "none", "", -1, ""

    def outline(self) -> list[tuple]:
        out: list[tuple] = []
        seen: set[int] = set()
        top = self.get(self.root, "Outlines")
        stack = [(top.get("First"), -1, 0, 0)] if isinstance(top, dict) else []
        while stack:
            ref, parent, depth, ord_ = stack.pop()
            node = self.doc.resolve(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref.num in seen or len(out) >= 100_000:
                continue
            if isinstance(ref, Ref):
                seen.add(ref.num)
            kind, dest, page, uri = self.action(node)
            me = len(out)
            out.append((me, parent, ord_, depth, text_string(self.get(node, "Title")), dest, page, kind, uri, (self.get(node, "Count") or 0) > 0))
            if "Next" in node:
                stack.append((node["Next"], parent, depth, ord_ + 1))
            if "First" in node:
                stack.append((node["First"], me, depth + 1, 0))
        return out

    def labels(self) -> list[tuple]:
        found: list[tuple] = []

        def walk(ref, depth: int) -> None:
            node = self.doc.resolve(ref)
            if not isinstance(node, dict) or depth > MAX_DEPTH:
                return
            numbers = self.get(node, "Nums") or []
            for start, label in zip(numbers[::2], numbers[1::2], strict=False):
                label = self.doc.resolve(label) or {}
                style = str(self.get(label, "S") or "")
                found.append((start, style if style in ("D", "R", "r", "A", "a") else "", text_string(self.get(label, "P")), max(self.get(label, "St") or 1, 1)))
            for kid in self.get(node, "Kids") or []:
                walk(kid, depth + 1)

        walk(self.root.get("PageLabels"), 0)
        last = {r[0]: r for r in found}
        return [(k, *last[s]) for k, s in enumerate(sorted(last))]

    def annots(self) -> list[tuple]:
        out = []
        for p, page in enumerate(self.pages):
            for k, ref in enumerate(self.doc.resolve(page.info.get("Annots")) or []):
                a = self.doc.resolve(ref)
                if not isinstance(a, dict):
                    continue
                box = [float(self.doc.resolve(v)) for v in self.get(a, "Rect") or [0, 0, 0, 0]]
                _, _, dest, uri = self.action(a)
                out.append((
                    p, k, str(a.get("Subtype", "")), min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3]), text_string(self.get(a, "Contents")), text_string(self.get(a, "T")),
                    uri, dest, text_string(self.get(a, "NM")), text_string(self.get(a, "M")), self.get(a, "F") or 0,
                ))
        return out

    def form(self) -> tuple[list[tuple], list[tuple]]:
        fields: list[tuple] = []
        signatures: list[tuple] = []
        form = self.get(self.root, "AcroForm")

        def value_text(v) -> str | None:
            v = self.doc.resolve(v)
            if isinstance(v, list):
                return "\n".join(value_text(x) or "" for x in v)
            return None if v is None else text_string(v) if isinstance(v, bytes) else str(v)

        def walk(ref, name: str, inherited: dict, depth: int) -> None:
            node = self.doc.resolve(ref)
            if not isinstance(node, dict) or depth > MAX_DEPTH:
                return
            own = inherited | {k: node[k] for k in ("FT", "Ff", "V", "MaxLen", "Opt") if k in node}
            part = text_string(self.get(node, "T")) if "T" in node else ""
            full = f"{name}.{part}" if name and part else name or part
            kids = [k for k in self.get(node, "Kids") or [] if isinstance(self.doc.resolve(k), dict)]
            inner = [k for k in kids if "T" in self.doc.resolve(k)]
            if inner:
                for kid in inner:
                    walk(kid, full, own, depth + 1)
                return
            kind, flags = str(self.doc.resolve(own.get("FT")) or ""), int(self.doc.resolve(own.get("Ff")) or 0)
            bit = lambda b: flags >> b & 1
            what = {"Tx": "text", "Sig": "signature", "Ch": "dropdown" if bit(17) else "list_box", "Btn": "push_button" if bit(16) else "radio" if bit(15) else "checkbox"}.get(kind, "unknown")
            states: list[str] = []
            for w in [node, *(self.doc.resolve(k) for k in kids)]:
                shapes = self.doc.resolve((self.get(w, "AP") or {}).get("N")) if isinstance(self.get(w, "AP"), dict) else None
                states += [s for s in (shapes if isinstance(shapes, dict) else {}) if s != "Off" and s not in states]
            options = []
            for o in self.doc.resolve(own.get("Opt")) or []:
                o = self.doc.resolve(o)
                options.append(text_string(o[1]) if isinstance(o, list) and len(o) > 1 else text_string(o) if isinstance(o, bytes) else str(o))
            signed = self.doc.resolve(own.get("V")) if what == "signature" else None
            shown = None if isinstance(signed, (dict, Stream)) else value_text(own.get("V"))
            fields.append((len(fields), full, what, shown, flags, self.doc.resolve(own.get("MaxLen")), options, states, bool(flags & 1)))
            if isinstance(signed, dict):
                span = [int(self.doc.resolve(v)) for v in self.get(signed, "ByteRange") or []]
                covers = len(span) == 4 and span[0] == 0 and span[2] + span[3] == len(self.doc.data)
                signatures.append((
                    len(signatures), full, str(signed.get("Filter", "")), str(signed.get("SubFilter", "")), text_string(self.get(signed, "Name")), text_string(self.get(signed, "M")),
                    text_string(self.get(signed, "Reason")), span, covers,
                ))

        for ref in self.get(form, "Fields") or [] if isinstance(form, dict) else []:
            walk(ref, "", {}, 0)
        return fields, signatures

    def attachments(self) -> list[tuple]:
        from ..functions.metadata import DEFAULT_TYPE, MEDIA_TYPES

        out = []
        for k, (key, ref) in enumerate(self.files):
            spec = self.doc.resolve(ref) or {}
            held = self.get(spec, "EF") or {}
            stream = self.doc.resolve(held.get("UF") or held.get("F"))
            if not isinstance(stream, Stream):
                continue
            data = self.doc.content(stream)
            name = text_string(key)
            shown = text_string(self.get(spec, "UF") or self.get(spec, "F")) or name
            mime = str(stream.info.get("Subtype", "")) or MEDIA_TYPES.get(shown.rpartition(".")[2].lower() if "." in shown else "", DEFAULT_TYPE)
            out.append((k, name, shown, text_string(self.get(spec, "Desc")), mime, len(data), data))
        return out

    def structure(self) -> list[tuple]:
        out: list[tuple] = []
        tree = self.get(self.root, "StructTreeRoot")

        def walk(ref, parent: int, ord_: int, depth: int) -> None:
            node = self.doc.resolve(ref)
            if not isinstance(node, dict) or "S" not in node or depth > 4 * MAX_DEPTH or len(out) >= 100_000:
                return
            me = len(out)
            page = node.get("Pg")
            out.append((me, parent, ord_, depth, str(node["S"]), *(text_string(self.get(node, k)) for k in ("T", "Alt", "ActualText")), self.index.get(page.num, -1) if isinstance(page, Ref) else -1))
            kids = self.get(node, "K")
            for k, kid in enumerate(kids if isinstance(kids, list) else [node.get("K")]):
                if isinstance(self.doc.resolve(kid), dict):
                    walk(kid, me, k, depth + 1)

        if isinstance(tree, dict):
            kids = self.get(tree, "K")
            for k, kid in enumerate(kids if isinstance(kids, list) else [tree.get("K")]):
                walk(kid, -1, k, 0)
        return out


def parse(data: bytes, password: str = "", tables: frozenset[str] | None = None) -> dict[str, list[tuple]]:
    """The asked tables of a document, or all."""
    wanted = tables or frozenset(TABLES)
    r = _Reader(data, password)
    doc = r.doc
    out: dict[str, list[tuple]] = {t: [] for t in TABLES}
    info = doc.resolve(doc.trailer.get("Info")) or {}
    props = (text_string(doc.resolve(info.get(k))) or None for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"))
    out["documents"].append((doc.version, len(r.pages), "Encrypt" in doc.trailer, doc.recovered, doc.notes[:64], *props))
    out["pages"] = [(k, p.box[2] - p.box[0], p.box[3] - p.box[1], p.rotate, p.num) for k, p in enumerate(r.pages)]
    if wanted & {"runs", "images"}:
        for k, page in enumerate(r.pages):
            runs, images = extract(doc, page)
            out["runs"] += [(k, i, t, x, y, s, f, w, v) for i, (t, x, y, s, f, w, v) in enumerate(runs)]
            out["images"] += [(k, i, *image) for i, image in enumerate(images)]
    if "objects" in wanted:
        for num in sorted({*doc.offsets, *doc.packed}):
            value = doc.resolve(Ref(num, 0))
            info = value.info if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            kind = {Stream: "stream", dict: "dict", list: "array", bytes: "string", Name: "name", bool: "bool", int: "int", float: "real"}.get(type(value), "null")
            out["objects"].append((num, kind, str(info.get("Type", "")) or None, len(value.raw) if isinstance(value, Stream) else None))
    out["outline"], out["labels"], out["annots"] = r.outline(), r.labels(), r.annots()
    out["fields"], out["signatures"] = r.form()
    out["attachments"], out["struct"] = r.attachments(), r.structure()
    return out


def document_text(data: bytes, password: str = "") -> str:
    """Text of all pages: blocks apart by empty lines, pages by form feeds."""
    from ..operators.layout import Run, page_text

    found: dict[int, list] = {}
    t = parse(data, password, frozenset({"runs"}))
    for page, _, text, x, y, size, _, w, vert in t["runs"]:
        found.setdefault(page, []).append(Run(text, x, y, size, w, vert))
    return "\f".join(page_text(found.get(k, [])) for k in range(len(t["pages"])))


__all__ = ["TABLES", "decoded", "document_text", "parse"]
