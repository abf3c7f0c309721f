"""Reading and writing of bytes and bits, and the one kind of error that decoders raise. No Spark here."""

from __future__ import annotations

import struct

#: Error codes and what they say.
ERRORS = {
    "ShortRead": "read past end of buffer", "BadMagic": "magic mismatch", "BadVersion": "unsupported version", "BadChecksum": "checksum mismatch",
    "BadLength": "inconsistent length or offset", "BadType": "unknown type tag", "DepthExceeded": "nesting depth exceeded",
    "StateViolation": "operation invalid in current state", "Unsupported": "unsupported feature", "Truncated": "structure truncated",
}
U64 = (1 << 64) - 1


class WireError(ValueError):
    """code is one of ERRORS; offset counts from the start of the file."""

    def __init__(self, code: str, offset: int, what: str = ""):
        super().__init__(f"[{ERRORS[code]} @ {offset}] {what}")
        self.code, self.offset, self.what = code, offset, what


def signed(v: int) -> int:
    """The 64 low bits of v as a signed number."""
    v &= U64
    return v - (1 << 64) if v >> 63 else v


class Reader:
    """A cursor over data[start:stop]; positions and errors are absolute."""

    def __init__(self, data, start: int = 0, stop: int | None = None):
        self.data, self.start, self.at, self.stop = data, start, start, len(data) if stop is None else stop

    @property
    def left(self) -> int:
        return self.stop - self.at

    def need(self, n: int) -> None:
        if n > self.left:
            raise WireError("ShortRead", self.at, f"{n} bytes wanted, {self.left} left")

    def seek(self, at: int) -> None:
        if not self.start <= at <= self.stop:
            raise WireError("BadLength", self.at, f"position {at} is outside")
        self.at = at

    def skip(self, n: int) -> None:
        self.need(n)
        self.at += n

    def take(self, n: int) -> bytes:
        self.need(n)
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def sub(self, n: int) -> Reader:
        """A reader of the next n bytes, which this one passes over."""
        self.need(n)
        self.at += n
        return Reader(self.data, self.at - n, self.at)

    def peek(self) -> int:
        self.need(1)
        return self.data[self.at]

    def match(self, head: bytes) -> bool:
        return bytes(self.data[self.at : min(self.at + len(head), self.stop)]) == head

    def number(self, size: int, order: str = "little") -> int:
        return int.from_bytes(self.take(size), order)

    def f64(self) -> float:
        return struct.unpack("<d", self.take(8))[0]

    def varint(self) -> int:
        """LEB128 of at most ten bytes; bits beyond 64 are lost."""
        value = 0
        for k in range(10):
            byte = self.number(1)
            value |= (byte & 0x7F) << 7 * k
            if byte < 0x80:
                return value & U64
        raise WireError("BadLength", self.at, "a varint of over ten bytes")

    def svarint(self) -> int:
        z = self.varint()
        return (z >> 1) ^ -(z & 1)

    def prefixed(self) -> bytes:
        return self.take(self.varint())


class BitReader:
    """Bits of data, the most significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return 8 * len(self.data) - self.at

    def bits(self, n: int) -> int:
        if n > 64:
            raise WireError("BadLength", self.at // 8, f"{n} bits at once")
        if n > self.left:
            raise WireError("ShortRead", self.at // 8, f"{n} bits wanted, {self.left} left")
        first, last = self.at // 8, -(-(self.at + n) // 8)
        window = int.from_bytes(self.data[first:last], "big")
        self.at += n
        return (window >> (8 * last - self.at)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if n > self.left:
            raise WireError("ShortRead", self.at // 8, f"{n} bits wanted, {self.left} left")
        self.at += n

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


class Writer:
    """Bytes put one after another; numbers may be patched later."""

    def __init__(self):
        self.data = bytearray()

    def number(self, v: int, size: int, order: str = "little") -> Writer:
        self.data += (v & ((1 << 8 * size) - 1)).to_bytes(size, order)
        return self

    def varint(self, v: int) -> Writer:
        v &= U64
        while v >= 0x80:
            self.data.append(v & 0x7F | 0x80)
            v >>= 7
        self.data.append(v)
        return self

    def svarint(self, v: int) -> Writer:
        return self.varint((v << 1) ^ (v >> 63))

    def f64(self, v: float) -> Writer:
        return self.put(struct.pack("<d", v))

    def put(self, data: bytes) -> Writer:
        self.data += data
        return self

    def prefixed(self, data: bytes) -> Writer:
        return self.varint(len(data)).put(data)

    def reserve(self, size: int) -> int:
        self.data += bytes(size)
        return len(self.data) - size

    def patch(self, at: int, v: int, size: int) -> None:
        self.data[at : at + size] = v.to_bytes(size, "little")
