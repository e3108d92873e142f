"""AES decryption and encryption in CBC mode, for PDF keys and streams; tables are made from the field's rules."""

from __future__ import annotations

from functools import lru_cache


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def _boxes() -> tuple[list[int], list[int], dict[int, list[int]]]:
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    box = []
    for a in inverse:
        s = a
        for k in range(1, 5):
            s ^= ((a << k) | (a >> (8 - k))) & 255
        box.append(s ^ 0x63)
    back = [0] * 256
    for i, s in enumerate(box):
        back[s] = i
    return box, back, {f: [_times(i, f) for i in range(256)] for f in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[list[int]]:
    box = _boxes()[0]
    n = len(key) // 4
    words = [list(key[4 * k : 4 * k + 4]) for k in range(n)]
    turn = 1
    for k in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if k % n == 0:
            w = [box[c] for c in w[1:] + w[:1]]
            w[0] ^= turn
            turn = _times(turn, 2)
        elif n > 6 and k % n == 4:
            w = [box[c] for c in w]
        words.append([a ^ b for a, b in zip(words[k - n], w, strict=True)])
    return [sum(words[k : k + 4], []) for k in range(0, len(words), 4)]


def _encrypt_block(keys: list[list[int]], block: list[int]) -> list[int]:
    box, _, mul = _boxes()
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, len(keys)):
        s = [box[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < len(keys) - 1:
            out = []
            for c in range(0, 16, 4):
                a = s[c : c + 4]
                out += [mul[2][a[i]] ^ mul[3][a[(i + 1) % 4]] ^ a[(i + 2) % 4] ^ a[(i + 3) % 4] for i in range(4)]
            s = out
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return s


def _decrypt_block(keys: list[list[int]], block: list[int]) -> list[int]:
    _, back, mul = _boxes()
    s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
    for r in range(len(keys) - 2, -1, -1):
        s = [back[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
        if r:
            out = []
            for c in range(0, 16, 4):
                a = s[c : c + 4]
                out += [mul[14][a[i]] ^ mul[11][a[(i + 1) % 4]] ^ mul[13][a[(i + 2) % 4]] ^ mul[9][a[(i + 3) % 4]] for i in range(4)]
            s = out
    return s


def decrypt(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """CBC; without ``iv`` the first block is it."""
    keys = _schedule(key)
    if iv is None:
        iv, data = data[:16], data[16:]
    out = bytearray()
    for k in range(0, len(data) - len(data) % 16, 16):
        block = data[k : k + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(keys, list(block)), iv, strict=True))
        iv = block
    if padded and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """CBC of whole blocks, without padding."""
    keys = _schedule(key)
    out = bytearray()
    for k in range(0, len(data), 16):
        iv = bytes(_encrypt_block(keys, [a ^ b for a, b in zip(data[k : k + 16], iv, strict=True)]))
        out += iv
    return bytes(out)
