"""Checksums, hashes, escapes and run lengths over bytes."""

from __future__ import annotations

import binascii
import re
import zlib

import numpy as np

from .cursor import U64

FNV32, FNV64 = (0x811C9DC5, 0x01000193), (0xCBF29CE484222325, 0x100000001B3)


def crc32(b: bytes, so_far: int = 0) -> int:
    return zlib.crc32(b, so_far)


def adler32(b: bytes) -> int:
    return zlib.adler32(b)


def crc16(b: bytes) -> int:
    """CCITT with initial value 0xFFFF."""
    return binascii.crc_hqx(b, 0xFFFF)


def fnv1a(b: bytes, bits: int = 64, so_far: int | None = None) -> int:
    start, prime = FNV32 if bits == 32 else FNV64
    h, mask = start if so_far is None else so_far, (1 << bits) - 1
    for byte in b:
        h = (h ^ byte) * prime & mask
    return h


def fnv1a_all(values: list[bytes], bits: int = 64) -> np.ndarray:
    """fnv1a of many values: a byte position at a time for all that reach it, the last few long ones on their own."""
    start, prime = FNV32 if bits == 32 else FNV64
    kind = np.uint32 if bits == 32 else np.uint64
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    at = (np.cumsum(size) - size)[order]
    flat, size = np.frombuffer(b"".join(values), np.uint8), size[order]
    h, step = np.full(len(values), start, kind), 0
    with np.errstate(over="ignore"):
        while (n := int(np.searchsorted(-size, -step, "left"))) >= 32:
            h[:n] = (h[:n] ^ flat[at[:n] + step].astype(kind)) * kind(prime)
            step += 1
    for k in range(n):
        h[k] = fnv1a(values[order[k]][step:], bits, int(h[k]))
    out = np.empty_like(h)
    out[order] = h
    return out


#: The increment and the factors of splitmix64.
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x):
    """splitmix64 of an int, or of an array of uint64."""
    if isinstance(x, int):
        return int(mix64(np.array([x & U64], np.uint64))[0])
    with np.errstate(over="ignore"):
        x = x + np.uint64(_GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def hash_combine(seed, value):
    """A hash of a seed and a further value, of ints or of arrays of uint64; the order of values matters."""
    if isinstance(seed, int):
        return int(hash_combine(np.array([seed & U64], np.uint64), np.array([value & U64], np.uint64))[0])
    with np.errstate(over="ignore"):
        return seed ^ (mix64(value) + np.uint64(_GOLDEN) + (seed << np.uint64(6)) + (seed >> np.uint64(2)))


def to_hex(v: int, digits: int = 1) -> str:
    return f"0x{v & U64:0{min(digits, 16)}x}"


_UNPRINTABLE = re.compile(rb"[^ -\[\]-~]")
_UNQUOTABLE = re.compile(rb"[^ !#-\[\]-~]")
_SHORT = {b"\\": b"\\\\", b'"': b'\\"', b"\n": b"\\n", b"\r": b"\\r", b"\t": b"\\t"}
_SHOWN = bytes(c if 32 <= c < 127 else 46 for c in range(256))


def escape(b: bytes) -> str:
    """Printable ASCII as it is, the backslash doubled, other bytes as \\xHH."""
    return _UNPRINTABLE.sub(lambda m: b"\\\\" if m[0] == b"\\" else b"\\x%02x" % m[0][0], b).decode()


def quote_escape(b: bytes) -> str:
    """As in configuration text: quotes and newlines have short forms too."""
    return _UNQUOTABLE.sub(lambda m: _SHORT.get(m[0]) or b"\\x%02x" % m[0][0], b).decode()


def hexdump(b: bytes) -> str:
    """Rows of 16 bytes: offset, bytes, printable characters."""
    rows = []
    for at in range(0, len(b), 16):
        part = b[at : at + 16]
        rows.append(f"{to_hex(at, 8)}  {part.hex(' ').ljust(48)} {part.translate(_SHOWN).decode()}\n")
    return "".join(rows)


RLE_MOST = 128
_RUN = re.compile(rb"(.)\1{1,%d}" % (RLE_MOST - 1), re.S)


def rle_compress(b: bytes) -> bytes:
    """Tokens of 1 to 128 bytes: 0x80 | n - 1 and a byte for a run of two or more, n - 1 and the bytes for others."""
    out, at = bytearray(), 0

    def plain(stop):
        for k in range(at, stop, RLE_MOST):
            part = b[k : min(k + RLE_MOST, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(b):
        plain(run.start())
        out.extend((0x80 | (run.end() - run.start() - 1), run[0][0]))
        at = run.end()
    plain(len(b))
    return bytes(out)


def rle_decompress(b: bytes, most: int = 1 << 24) -> tuple[str, bytes]:
    """(OK, MALFORMED or CAP_EXCEEDED; what was decoded until then)."""
    out, at = bytearray(), 0
    while at < len(b):
        control, n = b[at], (b[at] & 0x7F) + 1
        size = 1 if control & 0x80 else n
        if at + 1 + size > len(b):
            return "MALFORMED", bytes(out)
        if len(out) + n > most:
            return "CAP_EXCEEDED", bytes(out)
        out += b[at + 1 : at + 2] * n if control & 0x80 else b[at + 1 : at + 1 + n]
        at += 1 + size
    return "OK", bytes(out)
