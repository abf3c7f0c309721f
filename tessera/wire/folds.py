"""Stateful folds over a stream's ordered rows, used both in batch and in streaming.

A fold is made anew for each stream. step(row) yields the rows of SCHEMA; flush(), where there is one, what it still holds at
the end. state() gives all it knows as a tuple of STATE's columns, from which restore() goes on.
"""

from __future__ import annotations

from .frames import COMPRESSED, FIN, FRAG

MODULUS = 65_536


class SequenceFold:
    """Gaps, repeats and resets of sequence numbers. Rows: seq, is_reset. A running row for each frame."""

    SCHEMA = "seq long, frames long, gaps long, dups long, resets long"
    STATE = "last long, frames long, gaps long, dups long, resets long"

    def __init__(self):
        self.last = None
        self.frames = self.gaps = self.dups = self.resets = 0

    def state(self):
        return self.last, self.frames, self.gaps, self.dups, self.resets

    def restore(self, state):
        self.last, self.frames, self.gaps, self.dups, self.resets = state

    def step(self, r):
        self.frames += 1
        if self.last is not None and r["seq"] == self.last:
            self.dups += 1
        elif self.last is not None and r["seq"] != (self.last + 1) % MODULUS:
            self.gaps += 1
        self.last = r["seq"]
        if r["is_reset"]:
            self.resets, self.last = self.resets + 1, None
        yield r["seq"], self.frames, self.gaps, self.dups, self.resets


class ReassemblyFold:
    """Messages from fragments of one stream. Rows: frame_idx, type, flags, msg_id, frag_offset, payload.

    Fragments are kept as they came and laid over each other, later ones on top, when a message is
    complete: its end is known and one range covers it from 0. A RESET forgets what is in flight.
    """

    SCHEMA = "msg_id long, compressed boolean, data binary, completed_frame_idx long"
    STATE = "parts array<struct<msg_id:bigint,compressed:boolean,reach:bigint,total:bigint,frames:array<struct<at:bigint,payload:binary>>>>"

    def __init__(self, most: int = 1 << 30):
        self.parts, self.most, self.dropped = {}, most, 0

    def state(self):
        return ([(m, p["compressed"], p["reach"], p["total"], p["frames"]) for m, p in self.parts.items()],)

    def restore(self, state):
        for m, compressed, reach, total, parts in state[0]:
            self.parts[m] = {"compressed": compressed, "reach": reach, "total": total, "frames": [(at, bytes(part)) for at, part in parts]}

    @property
    def in_flight(self) -> int:
        """Messages that have begun and are not complete."""
        return len(self.parts)

    def step(self, r):
        self.dropped = len(self.parts) if r["type"] == "RESET" else 0
        if r["type"] == "RESET":
            self.parts.clear()
        if r["type"] != "DATA":
            return
        p = self.parts.setdefault(r["msg_id"], {"frames": [], "reach": 0, "total": None, "compressed": False})
        begin = r["frag_offset"] if r["flags"] & FRAG else 0
        payload = bytes(r["payload"] or b"")
        end = begin + len(payload)
        if end > self.most:
            raise ValueError(f"message {r['msg_id']} is longer than {self.most} bytes")
        p["compressed"] |= bool(r["flags"] & COMPRESSED)
        if payload:
            p["frames"].append((begin, payload))
        p["reach"] = max(p["reach"], end)
        if r["flags"] & FIN:
            p["total"] = p["reach"]
        if p["total"] is None or self._covered(p["frames"]) < p["total"]:
            return
        data = bytearray(max(p["reach"], 0))
        for at, part in p["frames"]:
            data[at : at + len(part)] = part
        del self.parts[r["msg_id"]]
        yield r["msg_id"], p["compressed"], bytes(data[: p["total"]]), r["frame_idx"]

    @staticmethod
    def _covered(frames) -> int:
        """The end of the one range that covers all from 0; -1 if there are several ranges."""
        end = 0
        for at, part in sorted(frames, key=lambda f: f[0]):
            if at > end:
                return -1
            end = max(end, at + len(part))
        return end


class FlightFold(ReassemblyFold):
    """What a reassembly holds after each frame. Rows as there; dropped counts the messages that a RESET has thrown away."""

    SCHEMA = "frame_idx long, completed long, in_flight long, dropped long"

    def step(self, r):
        completed = sum(1 for _ in super().step(r))
        yield r["frame_idx"], completed, self.in_flight, self.dropped


class DeliveryFold:
    """Messages in the order of their ids. Rows: msg_id. A row for each release: msg_id and why it could go.

    The first id sets the cursor. Ids behind it, or waiting already, are duplicates. When more than
    window ids wait, delivery jumps to the lowest of them, which counts as a gap. gaps and dups are totals so far.
    """

    SCHEMA = "msg_id long, gaps long, dups long"
    STATE = "next long, waiting array<bigint>, gaps long, dups long"

    def __init__(self, window: int = 64):
        self.window, self.next, self.waiting = max(window, 1), None, set()
        self.gaps = self.dups = 0

    def state(self):
        return self.next, sorted(self.waiting), self.gaps, self.dups

    def restore(self, state):
        self.next, waiting, self.gaps, self.dups = state
        self.waiting = set(waiting)

    def _drain(self):
        while self.next in self.waiting:
            self.waiting.discard(self.next)
            yield self._release(self.next)

    def _release(self, m):
        self.next = (m + 1) % 2**32
        return m, self.gaps, self.dups

    def step(self, r):
        m = r["msg_id"]
        if self.next is None or m == self.next:
            yield self._release(m)
            yield from self._drain()
        elif m < self.next or m in self.waiting:
            self.dups += 1
        else:
            self.waiting.add(m)
            if len(self.waiting) > self.window:
                self.gaps += 1
                self.next = min(self.waiting)
                yield from self._drain()

    def flush(self):
        """Releases all that wait; every hole is a gap."""
        while self.waiting:
            low = min(self.waiting)
            self.gaps += low != self.next
            self.next = low
            yield from self._drain()


class DeliveryTotals(DeliveryFold):
    """The totals of a delivery at the end of its stream: released in all, held back until then, holes and duplicates."""

    SCHEMA = "released long, buffered long, gaps long, dups long"
    STATE = DeliveryFold.STATE + ", released long"

    def __init__(self, window: int = 64):
        super().__init__(window)
        self.released = 0

    def state(self):
        return *super().state(), self.released

    def restore(self, state):
        super().restore(state[:-1])
        self.released = state[-1]

    def step(self, r):
        self.released += sum(1 for _ in super().step(r))
        return ()

    def flush(self):
        buffered = len(self.waiting)
        self.released += sum(1 for _ in super().flush())
        yield self.released, buffered, self.gaps, self.dups


class FlowFold:
    """Credit-based sending. Rows: kind (WINDOW, ACK or SEND), amount, point. A row for each: admitted, sent, acked, available, blocked, in_flight."""

    SCHEMA = "kind string, admitted long, sent long, acked long, available long, blocked boolean, in_flight long"
    STATE = "ceiling string, sent long, acked long"  # the ceiling is unsigned

    def __init__(self):
        self.ceiling = self.sent = self.acked = 0

    def state(self):
        return str(self.ceiling), self.sent, self.acked

    def restore(self, state):
        self.ceiling, self.sent, self.acked = int(state[0]), *state[1:]

    def step(self, r):
        admitted, wanted = 0, 0
        if r["kind"] == "WINDOW":
            self.ceiling = max(self.ceiling, min(r["point"] + r["amount"], 2**64 - 1))
        elif r["kind"] == "ACK":
            self.acked = min(max(self.acked, r["amount"]), self.sent)
        else:
            wanted = r["amount"]
            admitted = min(wanted, max(self.ceiling - self.sent, 0))
            self.sent += admitted
        yield r["kind"], admitted, self.sent, self.acked, max(self.ceiling - self.sent, 0), admitted < wanted, max(self.sent - self.acked, 0)


class JournalFold:
    """Write-ahead journal of one store, row by row. Rows: op, page, slot, bytes. A row for each operation that takes effect (null bytes: deleted)."""

    SCHEMA = "page long, slot long, bytes binary"
    STATE = "staged array<struct<page:bigint,slot:bigint,bytes:binary>>"

    def __init__(self):
        self.staged = None

    def state(self):
        return (self.staged,)

    def restore(self, state):
        self.staged = None if state[0] is None else [(page, slot, None if b is None else bytes(b)) for page, slot, b in state[0]]

    def step(self, r):
        op = r["op"]
        if op == "BEGIN":
            self.staged = []
        elif op in ("COMMIT", "ROLLBACK"):
            done, self.staged = self.staged or [], None
            if op == "COMMIT":
                yield from done
        else:
            row = (r["page"], r["slot"], None if op == "DELETE" else r["bytes"])
            if self.staged is None:
                yield row
            else:
                self.staged.append(row)
