"""Framed streams: bytes to frames, frames to bytes."""

from __future__ import annotations

from .cursor import Reader, Writer, WireError
from .digests import crc16

#: Fixed values of the format.
SYNC, VERSION, HEADER, RESYNC = b"\x53\xc7", 1, 19, 4096
TYPES = ("DATA", "CONTROL", "ACK", "RESET")
FIN, FRAG, COMPRESSED, HAS_CRC = 1, 2, 4, 8
MOST_PAYLOAD = 65_535


def _align(r: Reader, first: bool) -> None:
    if r.match(SYNC):
        return
    if first:
        raise WireError("BadMagic", r.at, "no frame at the start")
    found = bytes(r.data[r.at : r.stop]).find(SYNC, 0, RESYNC + 2)
    if found < 0 and r.left > RESYNC:
        raise WireError("BadMagic", r.at, "no frame within reach")
    r.skip(found if found >= 0 else r.left)


def decode(data: bytes, trailing: str = "error"):
    """Frames in order, as dicts. Junk after the last frame is an error unless trailing is 'ignore'."""
    r, i = Reader(data), 0
    while r.left:
        _align(r, i == 0)
        if r.left < 2:
            if trailing == "ignore":
                return
            raise WireError("ShortRead", r.at, "no frame after the last one")
        at = r.at
        head = r.take(HEADER)
        h = Reader(head, 2)
        version, kind, flags = h.number(1), h.number(1), h.number(1)
        if version != VERSION:
            raise WireError("BadVersion", at, f"version {version}")
        if kind >= len(TYPES):
            raise WireError("BadType", at, f"frame type {kind}")
        stream, msg, seq, offset, size = (h.number(n, "big") for n in (2, 4, 2, 4, 2))
        crc_ok = crc16(head) == r.number(2, "big") if flags & HAS_CRC else None
        payload = r.take(size)
        f = {"frame_idx": i, "header_offset": at, "type": TYPES[kind], "flags": flags, "stream_id": stream, "msg_id": msg, "seq": seq, "frag_offset": offset, "has_crc": bool(flags & HAS_CRC), "crc_ok": crc_ok, "payload": payload}
        f["ref_msg_id"], f["window"] = control(payload) if TYPES[kind] == "CONTROL" else (None, None)
        yield f
        i += 1


def control(payload: bytes) -> tuple[int, int]:
    """(acknowledged message, window); what is missing is 0."""
    return tuple(int.from_bytes(payload[k : k + 4], "big") if len(payload) >= k + 4 else 0 for k in (0, 4))


def encode_frame(kind: str = "DATA", stream: int = 0, msg: int = 0, seq: int = 0, payload: bytes = b"", flags: int = 0, frag_offset: int = 0, with_crc: bool = False) -> bytes:
    payload = payload[:MOST_PAYLOAD]
    flags = flags | HAS_CRC if with_crc else flags & ~HAS_CRC
    w = Writer().put(SYNC).number(VERSION, 1).number(TYPES.index(kind), 1).number(flags, 1)
    for v, n in ((stream, 2), (msg, 4), (seq, 2), (frag_offset, 4), (len(payload), 2)):
        w.number(v, n, "big")
    if with_crc:
        w.number(crc16(bytes(w.data)), 2, "big")
    return bytes(w.put(payload).data)


def encode_message(stream: int, msg: int, payload: bytes, most: int, first_seq: int = 0, compressed: bool = False, with_crc: bool = False) -> list[bytes]:
    """The frames of a message: FRAG if there are several, FIN on the last, seq counting up modulo 65536."""
    most = min(max(most, 1), MOST_PAYLOAD)
    parts = [payload[k : k + most] for k in range(0, len(payload), most)] or [b""]
    base = (COMPRESSED if compressed else 0) | (FRAG if len(parts) > 1 else 0)
    return [encode_frame("DATA", stream, msg, first_seq + k, p, base | (FIN if k == len(parts) - 1 else 0), k * most, with_crc) for k, p in enumerate(parts)]
