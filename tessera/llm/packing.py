"""Order-preserving packing of token streams into windows, by dynamic programming.

The documents of a partition form one stream of tokens. A window is at most ``size`` tokens of it and is
padded to ``size``, unless its length is a power of two. Cuts may fall after a document, after a
sentence, or, in long sentences, at every STRIDE-th token; the last two cost a penalty, so that few
documents are divided. With f(j) the least cost of cutting the stream at j,

    f(j) = penalty(j) + least over i in [j - size, j) of f(i) + padding(j - i) + WINDOW_COST

and padding(j - i) = size - j + i, so the least f(i) + i over a sliding range is needed, which a monotone
queue gives in constant time a cut; windows of a power of two, which need no padding, are tried beside it.

A partition is worked through in blocks of BLOCK windows; the last window of a block is not committed
but begins the next one, so memory does not grow with the partition. What remains at its end (less than
one window) is laid out in powers of two: no padding at all. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np

from .bpe import opened, vocabulary_path
from .common import bounded_batches

SIZE = 4096
END_OF_DOCUMENT = 2
SENTENCE_PENALTY, INNER_PENALTY, WINDOW_COST = 8.0, 24.0, 4.0
#: A cut is possible at least every so many tokens, so a window never pads more than this by want of cuts.
STRIDE = 64
BLOCK = 256


def cut_positions(boundaries: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """The cuts of least cost among boundaries (increasing, the first is 0, gaps up to size); the last is always one."""
    at, cost = boundaries.tolist(), penalties.tolist()
    n = len(at)
    place = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    f, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best, arg = f[i] + at[i] + size - here, i
        for p in powers:
            k = place.get(here - p)
            if k is not None and f[k] < best:
                best, arg = f[k], k
        f[j], back[j] = best + cost[j] + WINDOW_COST, arg
        key = f[j] + here
        while queue and f[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def stream_boundaries(ids: np.ndarray, sentence_end: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) at which a stream may be cut, 0 and its end included."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[1:][sentence_end[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    penalty[[0, n]] = 0.0
    sure = np.flatnonzero(np.isfinite(penalty))
    gap = np.diff(sure)
    long = np.flatnonzero(gap > STRIDE)
    if len(long):
        count = (gap[long] - 1) // STRIDE
        steps = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        penalty[np.repeat(sure[long], count) + steps * STRIDE] = INNER_PENALTY
        sure = np.flatnonzero(np.isfinite(penalty))
    return sure, penalty[sure]


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs one partition's documents, in order, in bounded memory; yields pieces."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int, size: int = SIZE):
        self.sentence_end, self.sequence, self.size = sentence_end, first_sequence, size
        self.docs: list[tuple] = []  # (doc id, start in the document, document's tokens, ids)
        self.held = 0

    def _emit(self, lengths: list[int]):
        """Pieces of windows of these lengths, taken from the front."""
        k, used = 0, 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc, start, total, ids = self.docs[k]
                take = min(length - offset, len(ids) - used)
                yield doc, start + used, take, zlib.crc32(ids[used : used + take].tobytes()), total, self.sequence, offset, length
                offset, used = offset + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if used:
            doc, start, total, ids = rest[0]
            rest[0] = (doc, start + used, total, ids[used:])
        self.docs = rest
        self.held -= sum(lengths)

    def add(self, doc, ids: np.ndarray):
        self.docs.append((doc, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= BLOCK * self.size:
            yield from self.pack(False)

    def pack(self, last: bool):
        """Commits all windows but the last of what is held; at the end all of it."""
        if not self.held:
            return
        stream = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        cuts = cut_positions(*stream_boundaries(stream, self.sentence_end, ends), self.size)
        if last:
            whole = [c for c in cuts if len(stream) - c >= self.size]
            lengths = np.diff([0, *whole]).tolist()
            rest = len(stream) - (whole[-1] if whole else 0)
            while rest >= self.size:
                lengths.append(self.size)
                rest -= self.size
            yield from self._emit(lengths + powers_of_two(rest))
        else:
            while cuts and len(stream) - cuts[-1] < self.size:
                cuts.pop()
            yield from self._emit(np.diff([0, *cuts]).tolist())


COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"


def pack(docs, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE):
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Each document is its ids and then END_OF_DOCUMENT; a null or empty text is that one id. Every id lies
    in exactly one piece; a sequence's pieces fill it without gaps from offset 0. Repeated rows are packed
    each for itself, rows with a null id too. An empty table gives no rows; only the two columns are read.
    sequence_id is unique: the partition's number times 2^33 and a count.
    """
    path = path or vocabulary_path("word_bpe_49k.json")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = opened(path)
        stop = np.zeros(bpe.size, bool)
        for token, i in bpe.vocab.items():
            mark = token.removesuffix(bpe.suffix)
            stop[i] = token.endswith(bpe.suffix) and mark[-1:] in (".", "!", "?")
        packer = Packer(stop, TaskContext.get().partitionId() << 33, size)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in COLUMNS.split(", ")])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        rows: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                    rows.extend(packer.add(doc, np.append(ids, END_OF_DOCUMENT).astype("<u4")))
                if len(rows) > 10_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.pack(True))
        if rows:
            yield batch(rows)

    return bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as t").mapInArrow(run, COLUMNS)
