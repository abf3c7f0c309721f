"""``python -m tessera FORMAT FILE``: decodes one file (- is standard input) and prints its summary.

FORMAT is bpk, mdb, cfg or sframe. Exits with 0, with 1 if the file cannot be read or decoded, with 2 if the call is wrong.
"""

from __future__ import annotations

import sys

from tessera.sources.formats import summarize_frames
from tessera.wire import bpk, cfg, frames, mdb
from tessera.wire.cursor import WireError


def _mdb(data: bytes) -> str:
    head = mdb.header(data)
    return mdb.summarize(data, head, mdb.pages(data, head))


SUMMARIES = {"bpk": lambda data: bpk.summarize(bpk.decode(data)), "mdb": _mdb, "cfg": lambda data: cfg.summarize(cfg.parse(data)), "sframe": lambda data: summarize_frames(frames.decode(data))}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in SUMMARIES:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        if args[1] == "-":
            data = sys.stdin.buffer.read()
        else:
            with open(args[1], "rb") as f:
                data = f.read()
        print(SUMMARIES[args[0]](data), end="")
    except (OSError, WireError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
