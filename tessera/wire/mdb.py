"""MDB1 page stores: header, pages, slots, strings, index pages, journal operations, record fields, overflow chains.

This module only takes bytes apart; replaying the journal and resolving strings are Spark plans.
"""

from __future__ import annotations

from .cursor import Reader, Writer, WireError
from .digests import crc32, escape, to_hex

#: Fixed values of the format.
MAGIC, VERSION, HEADER, PAGE_HEADER = b"MDB1", 1, 32, 8
NO_PAGE, NO_NEXT = 0xFFFFFFFF, 0xFFFF
PAGES = ("FREE", "DATA", "STRINGS", "INDEX", "OVERFLOW")
FIELDS = ("NULL", "BOOL", "INT", "UINT", "FLOAT", "STRING_REF", "INLINE_STRING", "BLOB")
OPS = {1: "BEGIN", 2: "INSERT", 3: "UPDATE", 4: "DELETE", 5: "COMMIT", 6: "ROLLBACK"}
MAX_CHAIN_PAGES, MAX_CHAIN_BYTES = 1024, 16 << 20


def header(data: bytes, strict: bool = False) -> dict:
    r = Reader(data)
    if len(data) < HEADER:
        raise WireError("ShortRead", 0, "header")
    if not r.match(MAGIC):
        raise WireError("BadMagic", 0, "store magic")
    r.skip(4)
    version, page_size = r.number(2), r.number(2)
    if version != VERSION:
        raise WireError("BadVersion", 4, f"version {version}")
    if not 64 <= page_size <= 8192 or page_size % 16:
        raise WireError("BadLength", 6, f"page size {page_size}")
    names = ("page_count", "root_page", "string_table_page", "journal_offset", "flags")
    out = {"version": version, "page_size": page_size} | {n: r.number(4) for n in names}
    out["checksum_ok"] = crc32(data[:28]) == r.number(4)
    if strict and not out["checksum_ok"]:
        raise WireError("BadChecksum", 28, "header")
    return out


def pages(data: bytes, head: dict) -> list[dict]:
    """Pages in order, each with its slots (offset, length, in_bounds) and the bytes of it that are there."""
    out = []
    for i in range(head["page_count"]):
        at = HEADER + i * head["page_size"]
        body = data[at : at + head["page_size"]]
        if not body:
            break
        p = {"page": i, "truncated": len(body) < head["page_size"], "type_code": 0, "flags": 0, "slot_count": 0, "free_start": 0, "overflow_next": NO_NEXT, "slots": [], "body": body}
        if len(body) >= PAGE_HEADER:
            r = Reader(body)
            p |= {"type_code": r.number(1), "flags": r.number(1), "slot_count": r.number(2), "free_start": r.number(2), "overflow_next": r.number(2)}
            for _ in range(min(p["slot_count"], r.left // 4)):
                offset, length = r.number(2), r.number(2)
                p["slots"].append((offset, length, offset >= PAGE_HEADER and offset + length <= head["page_size"]))
        p["type"] = PAGES[p["type_code"]] if p["type_code"] < len(PAGES) else "UNKNOWN"
        out.append(p)
    return out


def strings(data: bytes, head: dict, all_pages: list[dict]) -> list[bytes]:
    """The table's entries; what is cut short keeps its clean beginning, a missing or other page has none."""
    at = head["string_table_page"]
    if at == NO_PAGE or at >= len(all_pages) or all_pages[at]["type"] != "STRINGS":
        return []
    return _prefix(all_pages[at]["body"], lambda r: r.prefixed())[0]


def _prefix(body: bytes, entry) -> tuple[list, bool]:
    """(entries of a counted list from byte 8 on, whether it is cut short)."""
    out = []
    try:
        r = Reader(body, min(PAGE_HEADER, len(body)))
        for _ in range(r.varint()):
            out.append(entry(r))
    except WireError:
        return out, True
    return out, False


def index(page: dict) -> tuple[list[tuple], bool]:
    """((key, page, slot) by unsigned key, ties as they come; whether the page is cut short)."""
    if page["type"] != "INDEX":
        return [], False
    found, short = _prefix(page["body"], lambda r: (r.prefixed(), r.number(4), r.number(2)))
    return sorted(found, key=lambda e: e[0]), short


def seeds(all_pages: list[dict]):
    """(page, slot, bytes) of the records that lie in data pages before any journal."""
    for p in all_pages:
        if p["type"] == "DATA":
            for slot, (offset, length, ok) in enumerate(p["slots"]):
                if ok and length and offset + length <= len(p["body"]):
                    yield p["page"], slot, p["body"][offset : offset + length]


def journal(data: bytes, head: dict):
    """(op_idx, op, page, slot, bytes); an unknown operation ends the journal, a cut one is an error."""
    at = head["journal_offset"]
    if not at or at >= len(data):
        return
    r, i = Reader(data, at), 0
    while r.left:
        op = OPS.get(r.number(1))
        if op is None:
            return
        page = slot = body = None
        if op in ("INSERT", "UPDATE", "DELETE"):
            page, slot = r.number(4), r.number(2)
            body = r.prefixed() if op != "DELETE" else None
        yield i, op, page, slot, body
        i += 1


def fields(record: bytes) -> list[dict]:
    r, out = Reader(record), []
    for _ in range(r.varint()):
        at, code = r.at, r.number(1)
        if code >= len(FIELDS):
            raise WireError("BadType", at, f"field type {code}")
        f = dict.fromkeys(("b", "i64", "u64", "f64", "str", "ref_id", "blob")) | {"type": FIELDS[code]}
        if code == 1:
            f["b"] = r.number(1) != 0
        elif code == 2:
            f["i64"] = r.svarint()
        elif code in (3, 5):
            f["u64" if code == 3 else "ref_id"] = r.varint()
        elif code == 4:
            f["f64"] = r.f64()
        elif code > 5:
            f["str" if code == 6 else "blob"] = r.prefixed()
        out.append(f)
    return out


def overflow(all_pages: list[dict], start: int, max_pages: int = MAX_CHAIN_PAGES, max_bytes: int = MAX_CHAIN_BYTES) -> tuple[str, bytes, list[int]]:
    """(status, payloads one after another, pages visited) of the chain from start."""
    if not 0 <= start < len(all_pages):
        return "BAD_START", b"", []
    out, visited, at = bytearray(), [], start
    while True:
        if at in visited:
            return "CYCLE", bytes(out), visited
        if len(visited) >= max_pages:
            return "PAGE_LIMIT", bytes(out), visited
        p = all_pages[at]
        visited.append(at)
        payload = p["body"][PAGE_HEADER : max(PAGE_HEADER, p["free_start"])]
        if len(out) + len(payload) > max_bytes:
            return "LENGTH_LIMIT", bytes(out), visited
        out += payload
        at = p["overflow_next"]
        if at == NO_NEXT:
            return "COMPLETE", bytes(out), visited
        if at >= len(all_pages):
            return "DANGLING_PAGE", bytes(out), visited


def live(data: bytes, head: dict, all_pages: list[dict]) -> tuple[dict, int, int]:
    """({(page, slot): bytes} after the journal, operations that took effect, operations undone); for the texts below, one file at a time."""
    store, staged, done, undone = {(p, s): b for p, s, b in seeds(all_pages)}, None, 0, 0

    def apply(op, place, body):
        if op == "DELETE":
            store.pop(place, None)
        else:
            store[place] = body

    for _, op, page, slot, body in journal(data, head):
        if op == "BEGIN":
            staged = []
        elif op == "COMMIT":
            for x in staged or ():
                apply(*x)
            done, staged = done + len(staged or ()), None
        elif op == "ROLLBACK":
            undone, staged = undone + len(staged or ()), None
        elif staged is None:
            apply(op, (page, slot), body)
            done += 1
        else:
            staged.append((op, (page, slot), body))
    return store, done, undone + len(staged or ())


def _field_text(f: dict, texts: list[bytes]) -> str:
    kind = f["type"]
    if kind == "STRING_REF":
        found = f["ref_id"] < len(texts)
        return f"#{f['ref_id']} " + (f'"{escape(texts[f["ref_id"]])}"' if found else "<unresolved>")
    if kind == "INLINE_STRING":
        return f'"{escape(f["str"])}"'
    plain = {"NULL": "null", "BOOL": str(f["b"]).lower(), "INT": f["i64"], "UINT": f["u64"]}
    return f"blob[{len(f['blob'])}]" if kind == "BLOB" else f"{f['f64']:g}" if kind == "FLOAT" else str(plain[kind])


def summarize(data: bytes, head: dict, all_pages: list[dict]) -> str:
    """The store as an indented text."""
    store, done, undone = live(data, head, all_pages)
    texts = strings(data, head, all_pages)
    has_journal = 0 < head["journal_offset"] < len(data)
    facts = {name: head[name] for name in ("version", "page_size", "page_count", "root_page")}
    facts["string_table"] = "(none)" if head["string_table_page"] == NO_PAGE else f"page {head['string_table_page']}"
    facts["journal"] = f"offset {head['journal_offset']}, {done} committed, {undone} rolled back" if has_journal else "(none)"
    facts |= {"flags": to_hex(head["flags"], 8), "checksum_ok": "yes" if head["checksum_ok"] else "no"}
    lines = ["minidb MDB1 store", *[f"  {name:<14}: {v}" for name, v in facts.items()], f"string table ({len(texts)} entries)"]
    lines += [f'  [{i}] "{escape(t)}"' for i, t in enumerate(texts)]
    lines.append(f"pages ({len(all_pages)})")
    for p in all_pages:
        more = ("" if p["overflow_next"] == NO_NEXT else f", overflow_next={p['overflow_next']}") + (", truncated" if p["truncated"] else "")
        lines.append(f"  page {p['page']}: {p['type']}, slots={p['slot_count']}{more}")
    lines.append(f"committed records ({len(store)})")
    lines += [f"  (page {page}, slot {slot}): {', '.join(f'{f["type"]}={_field_text(f, texts)}' for f in fields(body))}" for (page, slot), body in sorted(store.items())]
    return "\n".join(lines) + "\n"


def catalog_text(data: bytes, head: dict, all_pages: list[dict]) -> str:
    """The catalog of a store as an indented text: pages by type, slots, strings, and the use of each page."""
    texts = strings(data, head, all_pages)
    counts = {k: sum(p["type"] == k for p in all_pages) for k in PAGES}
    used = [sum(ok and length > 0 for _, length, ok in p["slots"]) for p in all_pages]
    slots = [len(p["slots"]) for p in all_pages]
    kinds = " ".join(f"{k}={n}" for k, n in counts.items() if n) or "(none)"
    facts = {"pages": len(all_pages), "page types": kinds, "live records": len(live(data, head, all_pages)[0]), "slots used/dead": f"{sum(used)}/{sum(slots) - sum(used)}"}
    facts["strings"] = f"{len(texts)} entries, {sum(map(len, texts))} bytes, max {max(map(len, texts), default=0)}, {sum(not t for t in texts)} empty"
    lines = ["minidb catalog", *[f"  {name:<15}: {v}" for name, v in facts.items()], "  per-page:"]
    for p, u, n in zip(all_pages, used, slots, strict=True):
        lines.append(f"    page {p['page']}: {p['type']}, slots {u}/{n} used{f', {n - u} dead' if n > u else ''}{', truncated' if p['truncated'] else ''}")
    return "\n".join(lines) + "\n"


def encode_record(values: list[tuple]) -> bytes:
    """A record of (type, value) fields."""
    w = Writer().varint(len(values))
    for kind, v in values:
        w.number(FIELDS.index(kind), 1)
        if kind == "BOOL":
            w.number(int(v), 1)
        elif kind == "INT":
            w.svarint(v)
        elif kind in ("UINT", "STRING_REF"):
            w.varint(v)
        elif kind == "FLOAT":
            w.f64(v)
        elif kind != "NULL":
            w.prefixed(v)
    return bytes(w.data)


def encode_page(kind: str, page_size: int, slots: list[bytes] = (), body: bytes = b"", overflow_next: int = NO_NEXT) -> bytes:
    """A page of slots laid out behind their directory, or of a bare body."""
    w = Writer().number(PAGES.index(kind), 1).number(0, 1).number(len(slots), 2)
    at = PAGE_HEADER + 4 * len(slots)
    w.number(at + len(b"".join(slots)) if slots else PAGE_HEADER + len(body), 2).number(overflow_next, 2)
    for s in slots:
        w.number(at, 2).number(len(s), 2)
        at += len(s)
    w.put(b"".join(slots)).put(body)
    return bytes(w.data).ljust(page_size, b"\0")


def encode_strings(values: list[bytes]) -> bytes:
    w = Writer().varint(len(values))
    for v in values:
        w.prefixed(v)
    return bytes(w.data)


def encode_index(entries: list[tuple[bytes, int, int]]) -> bytes:
    w = Writer().varint(len(entries))
    for key, page, slot in entries:
        w.prefixed(key).number(page, 4).number(slot, 2)
    return bytes(w.data)


def encode_journal(ops: list[tuple]) -> bytes:
    codes, w = {v: k for k, v in OPS.items()}, Writer()
    for op, *args in ops:
        w.number(codes[op], 1)
        if args:
            w.number(args[0], 4).number(args[1], 2)
            if op != "DELETE":
                w.prefixed(args[2])
    return bytes(w.data)


def encode(page_size: int, pages_: list[bytes], string_page: int = NO_PAGE, journal_: bytes = b"", root: int = 0, flags: int = 0) -> bytes:
    at = HEADER + page_size * len(pages_)
    w = Writer().put(MAGIC).number(VERSION, 2).number(page_size, 2).number(len(pages_), 4).number(root, 4).number(string_page, 4)
    w.number(at if journal_ else 0, 4).number(flags, 4)
    w.number(crc32(bytes(w.data)), 4)
    return bytes(w.data) + b"".join(pages_) + journal_
