"""BPK1 containers: bytes to flat tables of sections and record nodes, and back.

A record tree is a list of nodes in pre-order, each with its parent, so no schema has to recurse.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .cursor import Reader, Writer, WireError
from .digests import crc32, escape, to_hex

#: Fixed values of the format.
MAGIC, VERSION, HEADER, ENTRY = b"BPK1", 1, 16, 24
HAS_METADATA, HAS_TRAILER, GROUP_FLAG = 1, 2, 1
SECTIONS = ("FREE", "DATA", "METADATA", "INDEX", "STRINGS")
TAGS = {1: "INT", 2: "UINT", 3: "FLOAT", 4: "STRING", 5: "BLOB", 6: "ARRAY", 7: "GROUP", 8: "KEYVAL"}
CODES = {v: k for k, v in TAGS.items()}


@dataclass
class Node:
    section: int
    node: int
    parent: int | None
    ordinal: int
    depth: int
    tag: str
    group: bool = False
    i64: int | None = None
    u64: int | None = None
    f64: float | None = None
    str: bytes | None = None
    blob: bytes | None = None
    key: bytes | None = None
    children: list = field(default_factory=list, repr=False)


@dataclass
class Container:
    version: int
    flags: int
    header_ok: bool
    trailer_ok: bool | None
    sections: list = field(default_factory=list)
    nodes: list = field(default_factory=list)
    metadata: list = field(default_factory=list)  # (key, value node)

    @property
    def checksum_ok(self) -> bool:
        return self.header_ok and self.trailer_ok is not False and all(s["crc_ok"] for s in self.sections)


def _verdict(computed: int, stored: int, strict: bool, at: int, what: str) -> bool:
    if strict and computed != stored:
        raise WireError("BadChecksum", at, what)
    return computed == stored


class _Records:
    """Decodes one section's records into the container's node list."""

    def __init__(self, nodes: list, section: int, max_depth: int):
        self.nodes, self.section, self.max_depth = nodes, section, max_depth

    def stream(self, r: Reader, parent: Node | None, depth: int) -> list:
        out = []
        while r.left:
            out.append(self.record(r, parent, len(out), depth))
        return out

    def record(self, r: Reader, parent: Node | None, ordinal: int, depth: int) -> Node:
        at = r.at
        if depth > self.max_depth:
            raise WireError("DepthExceeded", at, f"depth {depth}")
        code, flags = r.number(1), r.number(1)
        if code not in TAGS:
            raise WireError("BadType", at, f"record tag {code}")
        body = r.sub(r.varint())
        n = Node(self.section, len(self.nodes), parent and parent.node, ordinal, depth, TAGS[code], bool(flags & GROUP_FLAG))
        self.nodes.append(n)
        if n.tag == "INT":
            n.i64 = body.svarint()
        elif n.tag == "UINT":
            n.u64 = body.varint()
        elif n.tag == "FLOAT":
            n.f64 = body.f64()
        elif n.tag == "STRING":
            n.str = body.take(body.left)
        elif n.tag == "BLOB":
            n.blob = body.take(body.left)
        elif n.tag == "ARRAY":
            for k in range(body.varint()):
                n.children.append(self.record(body, n, k, depth + 1))
        elif n.tag == "GROUP":
            n.children = self.stream(body, n, depth + 1)
        else:
            n.key = body.prefixed()
            n.children = [self.record(body, n, 0, depth + 1)]
            if body.left:
                raise WireError("BadLength", body.at, "bytes after a key's value")
        return n


def decode(data: bytes, strict: bool = False, max_depth: int = 32) -> Container:
    r = Reader(data)
    if not r.match(MAGIC):
        raise WireError("ShortRead" if r.left < 4 else "BadMagic", 0, "container magic")
    r.skip(4)
    version, flags, count, _ = (r.number(2) for _ in range(4))
    if version != VERSION:
        raise WireError("BadVersion", 4, f"version {version}")
    c = Container(version, flags, _verdict(crc32(data[:12]), r.number(4), strict, 12, "header"), None)
    if count * ENTRY > r.left:
        raise WireError("BadLength", r.at, "the section table does not fit")
    for i in range(count):
        kind, ident, sflags, _ = (r.number(2) for _ in range(4))
        offset, length, items, stored = (r.number(4) for _ in range(4))
        if offset + length > len(data):
            raise WireError("BadLength", offset, f"section {i} does not fit")
        ok = _verdict(crc32(data[offset : offset + length]), stored, strict, offset, f"section {i}")
        roots = []
        if kind != 0:
            roots = _Records(c.nodes, i, max_depth).stream(Reader(data, offset, offset + length), None, 0)
        name = SECTIONS[kind] if kind < len(SECTIONS) else "UNKNOWN"
        c.sections.append({"section_idx": i, "type": name, "type_code": kind, "id": ident, "flags": sflags, "offset": offset, "length": length, "item_count": items, "crc": stored, "crc_ok": ok, "records": len(roots), "roots": roots})
        if name == "METADATA":
            c.metadata += [(n.key, n.children[0]) for n in roots if n.tag == "KEYVAL"]
    if flags & HAS_TRAILER:
        if len(data) < HEADER + 4:
            raise WireError("ShortRead", len(data), "trailer")
        c.trailer_ok = _verdict(crc32(data[:-4]), int.from_bytes(data[-4:], "little"), strict, len(data) - 4, "trailer")
    return c


class Visitor:
    """Hooks for walk; each gets what it is about and may yield results. depth is 0 for a section's own records, index the place among siblings."""

    def enter_section(self, section: dict):
        return ()

    def leave_section(self, section: dict):
        return ()

    def visit_scalar(self, node: Node):
        return ()

    def enter(self, node: Node):
        """An ARRAY, a GROUP or a KEYVAL, before its children."""
        return ()

    def leave(self, node: Node):
        return ()


def walk(c: Container, visitor: Visitor):
    """Everything the visitor's hooks yield, section by section and depth first."""
    for s in c.sections:
        yield from visitor.enter_section(s) or ()
        todo = [(n, False) for n in reversed(s["roots"])]
        while todo:
            n, done = todo.pop()
            if done:
                yield from visitor.leave(n) or ()
            elif n.tag not in ("ARRAY", "GROUP", "KEYVAL"):
                yield from visitor.visit_scalar(n) or ()
            else:
                yield from visitor.enter(n) or ()
                todo.append((n, True))
                todo += [(child, False) for child in reversed(n.children)]
        yield from visitor.leave_section(s) or ()


def validate(c: Container, max_depth: int = 32, max_blob: int = 1 << 20, check_item_count: bool = True) -> list[tuple]:
    """(severity, kind, section, path) of every issue, in document order, repeated metadata keys last."""
    out = []

    def visit(n: Node, path: str, depth: int):
        add = lambda severity, kind: out.append((severity, kind, n.section, path))
        if depth > max_depth:
            return add("ERROR", "depth_exceeded")
        if n.tag == "BLOB" and len(n.blob) > max_blob:
            add("WARNING", "oversized_blob")
        if n.tag in ("ARRAY", "GROUP") and not n.children:
            add("WARNING", f"empty_{n.tag.lower()}")
        if n.tag == "KEYVAL":
            if len(n.children) != 1:
                add("ERROR", "malformed_keyval")
            if not n.key:
                add("WARNING", "empty_metadata_key")
        for k, child in enumerate(n.children):
            visit(child, f"{path}/{n.tag.lower()}[{k}]", depth + 1)

    for s in c.sections:
        base = f"section[{s['section_idx']}]"
        if check_item_count and s["type"] != "FREE" and s["item_count"] != s["records"]:
            out.append(("ERROR", "item_count_mismatch", s["section_idx"], base))
        for k, n in enumerate(s["roots"]):
            visit(n, f"{base}/record[{k}]", 0)
    seen = set()
    for k, (key, _) in enumerate(c.metadata):
        if key in seen:
            out.append(("ERROR", "duplicate_metadata_key", 0, f"metadata[{k}]"))
        seen.add(key)
    return out


def _record(w: Writer, tag: str, value, group: bool) -> None:
    body = Writer()
    if tag == "INT":
        body.svarint(value)
    elif tag == "UINT":
        body.varint(value)
    elif tag == "FLOAT":
        body.f64(value)
    elif tag in ("STRING", "BLOB"):
        body.put(value)
    elif tag == "KEYVAL":
        body.prefixed(value[0])
        _record(body, *_spec(value[1]))
    else:
        if tag == "ARRAY":
            body.varint(len(value))
        for child in value:
            _record(body, *_spec(child))
    w.number(CODES[tag], 1).number(GROUP_FLAG if group else 0, 1).prefixed(bytes(body.data))


def _spec(spec: tuple):
    tag, value = spec[0], spec[1]
    return tag, value, (spec[2] if len(spec) > 2 else tag == "GROUP")


def encode(sections: list[dict], flags: int = 0) -> bytes:
    """A container of sections {type, id, records, item_count?, flags?}; a record is (tag, value): children for ARRAY and GROUP, (key, record) for KEYVAL."""
    bodies = []
    for s in sections:
        w = Writer()
        if s["type"] != "FREE":
            for spec in s.get("records", ()):
                _record(w, *_spec(spec))
        bodies.append(bytes(w.data))
    if any(s["type"] == "METADATA" for s in sections):
        flags |= HAS_METADATA
    head = Writer().put(MAGIC).number(VERSION, 2).number(flags, 2).number(len(sections), 2).number(0, 2)
    head.number(crc32(bytes(head.data)), 4)
    at = HEADER + ENTRY * len(sections)
    for s, body in zip(sections, bodies, strict=True):
        head.number(SECTIONS.index(s["type"]), 2).number(s.get("id", 0), 2).number(s.get("flags", 0), 2).number(0, 2)
        head.number(at, 4).number(len(body), 4).number(s.get("item_count", len(s.get("records", ()))), 4).number(crc32(body), 4)
        at += len(body)
    for body in bodies:
        head.put(body)
    if flags & HAS_TRAILER:
        head.number(crc32(bytes(head.data)), 4)
    return bytes(head.data)


def _scalar(n: Node) -> str | None:
    if n.tag == "STRING":
        return f'"{escape(n.str)}"'
    return {"INT": lambda: str(n.i64), "UINT": lambda: str(n.u64), "FLOAT": lambda: f"{n.f64:g}"}.get(n.tag, lambda: None)()


def summarize(c: Container) -> str:
    """The container as an indented text."""
    yes = lambda v: "true" if v else "false"
    lines = ["BPK1 container", f"  version       : {c.version}"]
    lines.append(f"  flags         : {to_hex(c.flags, 4)}{' has_metadata' if c.flags & HAS_METADATA else ''}{' has_trailer_crc' if c.flags & HAS_TRAILER else ''}")
    lines += [f"  checksum_ok   : {yes(c.checksum_ok)}", f"  header_crc_ok : {yes(c.header_ok)}"]
    if c.flags & HAS_TRAILER:
        lines.append(f"  trailer_crc_ok: {yes(c.trailer_ok)}")
    lines.append(f"  sections      : {len(c.sections)}")

    def show(n: Node, depth: int):
        head = "  " * depth + f"- {n.tag}" + (" (group)" if n.group else "")
        if n.tag == "BLOB":
            some = " ".join(to_hex(b, 2) for b in n.blob[:8])
            lines.append(f"{head}: {len(n.blob)} bytes" + (f" [{some}{' ...' if len(n.blob) > 8 else ''}]" if n.blob else ""))
        elif n.tag in ("ARRAY", "GROUP"):
            lines.append(f"{head}: {len(n.children)} {'elements' if n.tag == 'ARRAY' else 'records'}")
        elif n.tag == "KEYVAL":
            lines.append(f'{head}: key="{escape(n.key)}"')
        else:
            lines.append(f"{head}: {_scalar(n)}")
        for child in n.children:
            show(child, depth + 1)

    for s in c.sections:
        lines += ["", f"section[{s['section_idx']}] {s['type']} id={s['id']} flags={to_hex(s['flags'], 4)} item_count={s['item_count']} records={s['records']} body_crc_ok={yes(s['crc_ok'])}"]
        for n in s["roots"]:
            show(n, 1)
    if c.metadata:
        lines += ["", f"metadata ({len(c.metadata)} entries)"]
        for key, n in c.metadata:
            value = _scalar(n) or (f"<blob {len(n.blob)}>" if n.tag == "BLOB" else f"<{n.tag}>")
            lines.append(f"  {escape(key)} = {value}")
    return "\n".join(lines) + "\n"
