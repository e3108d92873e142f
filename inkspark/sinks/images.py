"""Image files of RGB pixels: PNG, BMP and TIFF, and the format that an extension asks for."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.metadata import EXPORT_FORMATS
from ..sources.package import FormatError


def format_for(name: str) -> str:
    """The format of a file name's extension."""
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    if extension not in EXPORT_FORMATS:
        raise FormatError(f"no format for the extension {extension!r}")
    return EXPORT_FORMATS[extension]


def png(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    rows = pixels[::-1, :, 2::-1].reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def tiff(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    data = pixels.tobytes()
    at = 8 + len(data) + len(data) % 2
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, channels, at if channels > 2 else 8), (259, 3, 1, 1), (262, 3, 1, 2 if channels >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, channels), (278, 4, 1, h), (279, 4, 1, len(data))]
    bits = struct.pack(f"<{channels}H", *[8] * channels) if channels > 2 else b""
    head = struct.pack("<2sHI", b"II", 42, at + len(bits))
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return head + data + b"\0" * (len(data) % 2) + bits + body


def encoded(pixels: np.ndarray, name: str) -> bytes:
    """Pixels as the format of a file name; formats that need a codec which is not here are refused."""
    kind = format_for(name)
    writers = {"png": png, "bmp": bmp, "tiff": tiff}
    if kind not in writers:
        raise FormatError(f"no encoder for {kind}")
    return writers[kind](pixels)
