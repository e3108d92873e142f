"""ZIP packages: checked reading, and the XML parts of office packages."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

MAX_ENTRY = 64 << 20
MAX_TOTAL = 512 << 20
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class FormatError(ValueError):
    """A file breaks the rules of its format; the message names the part."""


def safe_name(name: str) -> bool:
    """Whether an entry's name stays inside its folder."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match(r"[A-Za-z]:", name) and "\0" not in name


def entries(data: bytes, limit: int = MAX_ENTRY) -> list[tuple]:
    """(idx, name, method, csize, usize, crc, content) of all entries, checked: names, methods, sizes and checksums."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as error:
        raise FormatError(f"not a ZIP archive: {error}") from None
    out, total = [], 0
    for k, info in enumerate(archive.infolist()):
        if not safe_name(info.filename):
            raise FormatError(f"unsafe entry name {info.filename!r}")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
            raise FormatError(f"{info.filename}: unsupported compression or encryption")
        total += info.file_size
        if info.file_size > limit or total > MAX_TOTAL:
            raise FormatError(f"{info.filename}: larger than the limit")
        try:
            content = archive.read(info)
        except (zipfile.BadZipFile, zlib.error, EOFError) as error:
            raise FormatError(f"{info.filename}: {error}") from None
        out.append((k, info.filename, "stored" if info.compress_type == 0 else "deflated", info.compress_size, info.file_size, info.CRC, content))
    return out


def parts(data: bytes) -> dict[str, bytes]:
    """Contents by name, directories left out; of equal names the first."""
    if data.startswith(OLE):
        raise FormatError("an OLE container, not a ZIP package")
    found: dict[str, bytes] = {}
    for _, name, _, _, _, _, content in entries(data):
        if not name.endswith("/"):
            found.setdefault(name, content)
    return found


def local(tag: str) -> str:
    """A name without its namespace."""
    return tag.rpartition("}")[2]


def xml(found: dict[str, bytes], name: str) -> ET.Element:
    """The root of an XML part; a doctype is refused."""
    if name not in found:
        raise FormatError(f"missing part {name}")
    content = found[name]
    if b"<!DOCTYPE" in content[:4096]:
        raise FormatError(f"{name}: a document type is not allowed")
    try:
        return ET.fromstring(content)
    except ET.ParseError as error:
        raise FormatError(f"{name}: {error}") from None


def child(node: ET.Element | None, name: str) -> ET.Element | None:
    return None if node is None else next((c for c in node if local(c.tag) == name), None)


def children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if local(c.tag) == name]


def attr(node: ET.Element | None, name: str, default: str = "") -> str:
    """An attribute by its local name."""
    if node is None:
        return default
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def text_of(node: ET.Element | None) -> str:
    return "" if node is None else "".join(node.itertext())


def flag(node: ET.Element | None, default: bool = False) -> bool:
    """An on/off element: present means on unless its value says otherwise."""
    if node is None:
        return default
    return attr(node, "val", "true").lower() not in ("0", "false", "off", "none")


def rels(found: dict[str, bytes], part: str) -> dict[str, tuple[str, str, bool]]:
    """Relationship id to (type, target part or address, external)."""
    folder, _, name = part.rpartition("/")
    rel = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if rel not in found:
        return {}
    out = {}
    for r in children(xml(found, rel), "Relationship"):
        target, external = attr(r, "Target"), attr(r, "TargetMode") == "External"
        if not external:
            steps = [] if target.startswith("/") else folder.split("/") if folder else []
            for step in target.lstrip("/").split("/"):
                if step == "..":
                    steps = steps[:-1]
                elif step not in ("", "."):
                    steps.append(step)
            target = "/".join(steps)
        out[attr(r, "Id")] = (attr(r, "Type").rpartition("/")[2], target, external)
    return out
