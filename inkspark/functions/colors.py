"""Theme tints in hue, saturation and lightness, and pixels of raw images."""

from __future__ import annotations

import colorsys

import numpy as np


def tinted(base: str, tint: float) -> str:
    """RRGGBB with its lightness moved toward black (negative tint) or white."""
    if tint == 0:
        return base.upper()
    r, g, b = (int(base[k : k + 2], 16) / 255 for k in (0, 2, 4))
    h, l, s = colorsys.rgb_to_hls(r, g, b)  # noqa: E741
    l = l * (1 + tint) if tint < 0 else l * (1 - tint) + tint  # noqa: E741
    return "".join(f"{int(c * 255 + 0.5):02X}" for c in colorsys.hls_to_rgb(h, min(max(l, 0.0), 1.0), s))


def samples(data: bytes, width: int, height: int, channels: int, bits: int) -> np.ndarray:
    """Samples (height, width, channels) as bytes; rows begin on whole bytes, samples of 16 bits keep their first byte."""
    row = (width * channels * bits + 7) // 8
    raw = np.frombuffer(data.ljust(row * height, b"\0")[: row * height], np.uint8).reshape(height, row)
    if bits == 16:
        raw = raw[:, ::2]
    elif bits < 8:
        spread = np.unpackbits(raw, axis=1).reshape(height, -1, bits)
        raw = (spread @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
    return raw[:, : width * channels].reshape(height, width, channels)


def to_rgb(pixels: np.ndarray, space: str, bits: int = 8, palette: bytes = b"") -> np.ndarray:
    """Pixels of DeviceGray, DeviceRGB, DeviceCMYK or Indexed (an RGB palette) as RGB."""
    if space == "Indexed":
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        return table[np.minimum(pixels[..., 0], len(table) - 1)]
    full = pixels if bits >= 8 else (pixels.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if space == "DeviceGray":
        return np.repeat(full, 3, axis=2)
    if space == "DeviceCMYK":
        light = 255 - full.astype(np.uint16)
        return (light[..., :3] * light[..., 3:] // 255).astype(np.uint8)
    return full[..., :3]


def downscaled(pixels: np.ndarray, factor: int) -> np.ndarray:
    """Means of squares of ``factor`` pixels; what does not fill a square is left out."""
    h, w = pixels.shape[0] // factor * factor, pixels.shape[1] // factor * factor
    return pixels[:h, :w].reshape(h // factor, factor, w // factor, factor, -1).mean(axis=(1, 3)).astype(np.uint8)
