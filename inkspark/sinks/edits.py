"""Changes to existing documents: revisions of word-processing files, form fields and attachments of PDFs."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from ..sources.cos import Document, Name, Ref, Stream, text_string
from ..sources.package import FormatError, entries, local
from .packages import zip_bytes
from .pdf import updated

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_MAIN = "word/document.xml"


def _settle(node: ET.Element, keep: set[str], drop: set[str]) -> None:
    """Unwrap the kept wrappers below ``node`` and remove the dropped ones, in place."""
    out: list[ET.Element] = []
    for c in list(node):
        name = local(c.tag)
        if name in drop:
            continue
        _settle(c, keep, drop)
        out += list(c) if name in keep and len(c) else [] if name in keep else [c]
    for c in list(node):
        node.remove(c)
    node.extend(out)


def settle_revisions(data: bytes, view: str = "accept") -> bytes:
    """The document with all revisions of its body accepted, or rejected (``view="reject"``); all other parts stay as they are."""
    old = [(n, c) for _, n, _, _, _, _, c in entries(data)]
    if _MAIN not in dict(old):
        raise FormatError(f"missing part {_MAIN}")
    for prefix, uri in {v for _, v in ET.iterparse(__import__("io").BytesIO(dict(old)[_MAIN]), ["start-ns"])}:
        if prefix and not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(dict(old)[_MAIN])
    body = next((c for c in root if local(c.tag) == "body"), None)
    if body is None:
        raise FormatError(f"{_MAIN}: no body")
    accept = view == "accept"
    for p in list(body.iter()):
        for props in [c for c in p if local(c.tag) in ("pPr", "rPr", "tblPr", "trPr", "tcPr")]:
            change = next((c for c in props if local(c.tag) == f"{local(props.tag)}Change"), None)
            if change is None:
                continue
            props.remove(change)
            if not accept:
                for c in list(props):
                    props.remove(c)
                props.extend(list(change[0]) if len(change) else [])
    for p in body.iter():
        if local(p.tag) in ("rPr", "trPr"):
            for mark in [c for c in p if local(c.tag) in ("ins", "del", "moveFrom", "moveTo") and not len(c)]:
                p.remove(mark)
    _settle(body, {"ins", "moveTo"} if accept else {"del", "moveFrom"}, {"del", "moveFrom"} if accept else {"ins", "moveTo"})
    for node in body.iter():
        if local(node.tag) == "delText":
            node.tag = node.tag.replace("delText", "t")
    new = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + ET.tostring(root)
    return zip_bytes([(n, new if n == _MAIN else c) for n, c in old if not n.endswith("/")])


def _fields(doc: Document) -> dict[str, tuple[Ref, dict, dict]]:
    """Terminal fields by full name: reference, own dictionary, inherited values."""
    root = doc.resolve(doc.trailer["Root"])
    form = doc.resolve(root.get("AcroForm")) or {}
    out: dict[str, tuple[Ref, dict, dict]] = {}

    def walk(ref, name: str, inherited: dict, depth: int) -> None:
        node = doc.resolve(ref)
        if not isinstance(node, dict) or depth > 32:
            return
        own = inherited | {k: node[k] for k in ("FT", "Ff", "V", "DV", "MaxLen", "Opt") if k in node}
        part = text_string(doc.resolve(node["T"])) if "T" in node else ""
        full = f"{name}.{part}" if name and part else name or part
        inner = [k for k in doc.resolve(node.get("Kids")) or [] if "T" in (doc.resolve(k) or {})]
        for kid in inner:
            walk(kid, full, own, depth + 1)
        if not inner and isinstance(ref, Ref):
            out.setdefault(full, (ref, node, own))

    for ref in doc.resolve(form.get("Fields")) or []:
        walk(ref, "", {}, 0)
    return out


def _opened(data: bytes) -> tuple[Document, dict[str, tuple[Ref, dict, dict]]]:
    doc = Document.open(data)
    if "Encrypt" in doc.trailer:
        raise FormatError("an encrypted file cannot be filled")
    return doc, _fields(doc)


def _shape(doc: Document, own: dict) -> tuple[str, int]:
    return str(doc.resolve(own.get("FT")) or ""), int(doc.resolve(own.get("Ff")) or 0)


def _writable(doc: Document, fields: dict[str, tuple[Ref, dict, dict]], name: str) -> tuple[Ref, dict, dict]:
    if name not in fields:
        raise FormatError(f"no field {name!r}")
    if _shape(doc, fields[name][2])[1] & 1:
        raise FormatError(f"field {name!r} is read-only")
    return fields[name]


def _options(doc: Document, own: dict) -> list[tuple[str, str]]:
    """(export, display) of each option."""
    out = []
    for o in doc.resolve(own.get("Opt")) or []:
        o = doc.resolve(o)
        out.append((text_string(o[0]), text_string(o[1])) if isinstance(o, list) else (text_string(o), text_string(o)))
    return out


def _pressed(doc: Document, name: str, ref: Ref, node: dict, value: str | bool | None) -> dict[int, object]:
    """Objects of a box or a group of radio buttons in a state; None leaves it without a value, and off."""
    changes: dict[int, object] = {}
    widgets = [(ref, node), *((k, doc.resolve(k)) for k in doc.resolve(node.get("Kids")) or [])]
    states = {id(w): [s for s in _states(doc, w) if s != "Off"] for _, w in widgets}
    every = [s for _, w in widgets for s in states[id(w)]]
    if isinstance(value, bool):
        last = next((states[id(w)] for _, w in reversed(widgets) if states[id(w)]), ["Yes"])
        value = last[0] if value else "Off"
    elif value is not None and value != "Off" and value not in every:
        raise FormatError(f"field {name!r} has no state {value!r}")
    for r, w in widgets:
        shown = value if value in states[id(w)] or (value is not None and r is ref and len(widgets) == 1) else "Off"
        new = dict(w)
        if states[id(w)] or len(widgets) == 1:
            new["AS"] = Name(shown)
        if r is ref:
            new["V"] = None if value is None else Name(value)
        if isinstance(r, Ref):
            changes[r.num] = new
    return changes


def _filled(data: bytes, doc: Document, changes: dict[int, object]) -> bytes:
    """The file with changed fields, whose looks readers draw anew."""
    root = doc.resolve(doc.trailer["Root"])
    form = root.get("AcroForm")
    fresh = {**(doc.resolve(form) or {}), "NeedAppearances": True}
    if isinstance(form, Ref):
        changes[form.num] = fresh
    else:
        changes[doc.trailer["Root"].num] = {**root, "AcroForm": fresh}
    return updated(data, changes)


def fill(data: bytes, values: dict[str, str | bool]) -> bytes:
    """The file with form fields set by an appended update: texts (cut to their longest), choices by display or export
    value, boxes and radio buttons by state or truth.  Unknown and read-only fields are refused."""
    doc, fields = _opened(data)
    changes: dict[int, object] = {}
    for name, value in values.items():
        ref, node, own = _writable(doc, fields, name)
        kind, flags = _shape(doc, own)
        if kind == "Tx":
            longest = doc.resolve(own.get("MaxLen"))
            text = str(value)[:longest] if longest else str(value)
            changes[ref.num] = {**node, "V": _text(text)}
        elif kind == "Ch":
            export = next((a for a, b in _options(doc, own) if value in (a, b)), None)
            if export is None and not (flags >> 17 & 1 and flags >> 18 & 1):
                raise FormatError(f"field {name!r} has no option {value!r}")
            changes[ref.num] = {**node, "V": _text(export if export is not None else str(value))}
        elif kind == "Btn" and not flags >> 16 & 1:
            changes |= _pressed(doc, name, ref, node, value)
        else:
            raise FormatError(f"field {name!r} cannot be filled")
    return _filled(data, doc, changes)


def choose(data: bytes, name: str, wanted: list[str]) -> bytes:
    """The file with the wanted options of a choice field selected, by display or export value, repeats once.  Several
    need a list box that allows them, and are kept in the order of the options with their indices; one is a plain value,
    none clears the field."""
    doc, fields = _opened(data)
    ref, node, own = _writable(doc, fields, name)
    kind, flags = _shape(doc, own)
    if kind != "Ch":
        raise FormatError(f"field {name!r} has no choices")
    if len(wanted) > 1 and (flags >> 17 & 1 or not flags >> 21 & 1):
        raise FormatError(f"field {name!r} takes one option")
    options = _options(doc, own)
    picked: dict[str, int] = {}
    for w in wanted:
        at = next((i for i, pair in enumerate(options) if w in pair), None)
        if at is None:
            raise FormatError(f"field {name!r} has no option {w!r}")
        picked.setdefault(options[at][0], at)
    order = sorted(picked, key=lambda e: picked[e])
    new = {**node, "V": None, "I": None}
    if len(order) == 1:
        new["V"] = _text(order[0])
    elif order:
        new["V"], new["I"] = [_text(e) for e in order], [picked[e] for e in order]
    return _filled(data, doc, {ref.num: new})


def reset(data: bytes, names: list[str] | None = None) -> bytes:
    """The file with fields set to their defaults, and without a value where they have none.  Without names every field that
    can be filled is reset and the others are passed by; a named field that is unknown, read-only or of another kind is
    refused, as is a default of the wrong type."""
    doc, fields = _opened(data)
    changes: dict[int, object] = {}
    for name in fields if names is None else names:
        ref, node, own = _writable(doc, fields, name) if names is not None else fields[name]
        kind, flags = _shape(doc, own)
        if kind not in ("Tx", "Ch", "Btn") or (kind == "Btn" and flags >> 16 & 1) or flags & 1:
            if names is not None:
                raise FormatError(f"field {name!r} cannot be reset")
            continue
        default = doc.resolve(own.get("DV"))
        default = [doc.resolve(x) for x in default] if isinstance(default, list) else default
        if kind == "Btn":
            if default is not None and not isinstance(default, Name):
                raise FormatError(f"the default of field {name!r} is not a state")
            changes |= _pressed(doc, name, ref, node, None if default is None else str(default))
            continue
        several = default if kind == "Ch" and isinstance(default, list) else [] if default is None else [default]
        if not all(isinstance(x, bytes) for x in several):
            raise FormatError(f"the default of field {name!r} is not a text")
        new = {**node, "V": default}
        if kind == "Ch":
            exports = [e for e, _ in _options(doc, own)]
            at = sorted({exports.index(text_string(x)) for x in several if text_string(x) in exports})
            new["I"] = at if isinstance(default, list) and at else None
        changes[ref.num] = new
    return _filled(data, doc, changes)


def _states(doc: Document, widget: dict) -> list[str]:
    shapes = doc.resolve((doc.resolve(widget.get("AP")) or {}).get("N")) if "AP" in widget else None
    return list(shapes) if isinstance(shapes, dict) else []


def _text(text: str) -> bytes:
    return text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


def attach(data: bytes, files: list[tuple[str, bytes, str]]) -> bytes:
    """The file with (name, content, description) embedded by an appended update, names in order of the tree."""
    from ..functions.metadata import DEFAULT_TYPE, MEDIA_TYPES
    from ..sources.pdf import name_tree

    doc = Document.open(data)
    root = doc.resolve(doc.trailer["Root"])
    names = doc.resolve(root.get("Names")) or {}
    pairs = {bytes(k): v for k, v in name_tree(doc, names.get("EmbeddedFiles"))} if "EmbeddedFiles" in names else {}
    free = max([*doc.offsets, *doc.packed], default=0) + 1
    changes: dict[int, object] = {}
    for name, content, description in files:
        key = _text(name)
        if key in pairs:
            raise FormatError(f"an attachment {name!r} is already there")
        mime = MEDIA_TYPES.get(name.rpartition(".")[2].lower() if "." in name else "", DEFAULT_TYPE)
        changes[free] = Stream({"Type": Name("EmbeddedFile"), "Subtype": Name(mime), "Params": {"Size": len(content)}}, content)
        changes[free + 1] = {"Type": Name("Filespec"), "F": key, "UF": key, "Desc": _text(description), "EF": {"F": Ref(free, 0)}}
        pairs[key] = Ref(free + 1, 0)
        free += 2
    tree = [x for k in sorted(pairs) for x in (k, pairs[k])]
    changes[doc.trailer["Root"].num] = {**root, "Names": {**names, "EmbeddedFiles": {"Names": tree}}}
    return updated(data, changes)
