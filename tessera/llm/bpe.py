"""BPE encoding and decoding in batched numpy merge rounds.

The texts of a batch lie in one flat array of code points. Character classes cut it into pieces as the
vocabulary's pattern does; a piece is looked up by a 64-bit hash, and the ids found have to spell its bytes. Pieces not seen
before are merged together: the symbols of all of them lie in one flat array, and each round finds the
rank of every pair by binary search over the sorted pair keys, takes the lowest of each piece and merges
all its places, left to right. A worker keeps what it has merged in sorted arrays of bounded size
(CACHE_PIECES); beyond that it starts anew. Nothing here depends on the size of the table.

Two vocabularies: ``byte`` (byte-level, spaces belong to the words after them) and ``word`` (NFC and lower case, white
space dropped, a mark at the end of each word).
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

CACHE_PIECES = 600_000
#: Code points of the texts that are encoded together; a longer text is on its own.
GROUP_CHARS = 500_000
_SPACE, _OTHER, _LETTER, _NUMBER, _SEP = 0, 1, 2, 3, 4
_SEP_CP = 0x10FFFF
_INF = np.int64(2**62)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict = {}

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """The class of every code point: white space, letter, number, any other."""
    if "classes" not in _tables:
        cat = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((cat.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE] = _SPACE
        t[_SEP_CP] = _SEP
        _tables["classes"] = t
    return _tables["classes"]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _powers(n: int) -> np.ndarray:
    p = _tables.get("powers")
    if p is None or len(p) < n:
        p = np.empty(max(n, 4096), np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(p) - 1, _B))), out=p)
        _tables["powers"] = p
    return p


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class BatchBPE:
    """A vocabulary file of the tokenizers library, used in batches; see the module."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.word = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_chars()
        self.first = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        size = self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        left, right, made = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            made.append(self.vocab[a + b])
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        back = {c: b for b, c in enumerate(chars)}
        raw = [b""] * size
        for token, i in self.vocab.items():
            end = self.suffix if self.suffix and token.endswith(self.suffix) else ""
            raw[i] = bytes(back[c] for c in token[: len(token) - len(end)]) + (b" " if end else b"")
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.token_len = np.array([len(x) for x in raw], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _forget(self):
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.at, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16 if self.size <= 65536 else np.int32)

    # -- pieces ---------------------------------------------------------------------------------

    def _clean(self, text: str) -> str:
        if not self.word or text.isascii():
            return text.lower() if self.word else text
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, cp: np.ndarray, kind: np.ndarray):
        """Where pieces start, and where they end, as indices of code points."""
        n = len(cp)
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        sep = kind == _SEP
        cut[:n] |= sep
        cut[1:] |= sep
        space = kind == _SPACE
        attach = None
        if self.word:
            cut[:n] |= kind == _NUMBER
        else:
            # Of white space before something else the last one is a piece of its own, or belongs to what follows if it is U+0020.
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~sep[1:]
            cut[:n] |= last
            attach = last & (cp == 32)
            cut[1:n][attach[: n - 1]] = False
        quote = np.flatnonzero((cp[:-1] == 39) & cut[:-2] & cut[1:-1] & (kind[1:] == _LETTER))
        if attach is not None and len(quote):
            quote = quote[~((quote > 0) & attach[quote - 1])]
        if len(quote):
            c1 = cp[quote + 1]
            c2 = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
            q, size = quote[one | two], np.where(one, 1, 2)[one | two]
            cut[q + 1] = False
            after = q + 1 + size
            cut[after] = True
        bounds = np.flatnonzero(cut)
        start, end = bounds[:-1], bounds[1:]
        good = ~sep[start]
        if self.word:
            good &= ~space[start]
        return start[good], end[good]

    # -- merging --------------------------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.ranks[i], _INF)

    def _merge(self, sym: np.ndarray, lengths: np.ndarray):
        """(symbols, lengths) after all merges; sym holds the pieces' symbols one after another."""
        done_sym, done_len, done_id = [], [], []
        ids = np.arange(len(lengths))
        head = np.zeros(len(sym), bool)
        head[np.cumsum(lengths) - lengths] = True
        rank = np.full(len(sym), _INF)  # of the pair that begins here
        inner = np.flatnonzero(~head)
        rank[inner - 1] = self._rank(sym[inner - 1], sym[inner])
        while len(ids):
            starts = np.flatnonzero(head)
            low = np.minimum.reduceat(rank, starts)
            over = low == _INF
            if over.any():
                part = np.repeat(over, lengths)
                done_sym.append(sym[part])
                done_len.append(lengths[over])
                done_id.append(ids[over])
                rest = ~part
                sym, rank, head = sym[rest], rank[rest], head[rest]
                ids, lengths, low = ids[~over], lengths[~over], low[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            if len(at) > 1:  # a a a: every second one of adjacent places
                fresh = np.ones(len(at), bool)
                fresh[1:] = at[1:] != at[:-1] + 1
                if not fresh.all():
                    run = np.flatnonzero(fresh)
                    offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    at = at[offset % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            piece = np.cumsum(head) - 1
            lengths = lengths - np.bincount(piece[at], minlength=len(ids))
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            prev = at[~head[at]] - 1
            prev = np.where(keep[prev], prev, prev - 1)
            touched[prev] = True
            sym, rank, head, touched = sym[keep], rank[keep], head[keep], touched[keep]
            t = np.flatnonzero(touched)
            rank[t] = _INF
            t = t[t + 1 < len(sym)]
            t = t[~head[t + 1]]
            rank[t] = self._rank(sym[t], sym[t + 1])
        sym, lengths, ids = np.concatenate(done_sym), np.concatenate(done_len), np.concatenate(done_id)
        at = np.cumsum(lengths) - lengths
        order = np.argsort(ids)
        return sym[ragged(at[order], lengths[order])], lengths[order]

    # -- encoding -------------------------------------------------------------------------------

    def _batch(self, texts: list[str]):
        """(ids flat, number of ids of each text); texts hold no special token."""
        joined = chr(_SEP_CP).join([self._clean(t) for t in texts]) + chr(_SEP_CP)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        if len(raw) == len(joined):
            cp, byte_at = raw.astype(np.int32), None
        else:
            cp = np.frombuffer(joined.encode("utf-32-le"), np.int32)
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            byte_at = np.concatenate(([0], np.cumsum(width)))
        kind = classes()[cp]
        start, end = self._pieces(cp, kind)
        seps = np.flatnonzero(kind == _SEP)
        owner = np.searchsorted(seps, start)
        if byte_at is not None:
            start, end = byte_at[start], byte_at[end]
        size = end - start
        if not len(start):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        # A hash of each piece: sums of bytes times powers, all at once, then the powers' common factor mixed in by place.
        with np.errstate(over="ignore"):
            flat = raw if int(size.sum()) == len(raw) else raw[ragged(start, size)]
            local = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            h = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[local], np.cumsum(size) - size)
            h = _mix(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, uniq)
        pos_ok = np.minimum(pos, max(len(self.known) - 1, 0))
        have = (self.known[pos_ok] == uniq) if len(self.known) else np.zeros(len(uniq), bool)
        if not have.all():
            self._learn(uniq[~have], raw, start[where[~have]], size[where[~have]])
            pos_ok = np.searchsorted(self.known, uniq)
            if (self.known[np.minimum(pos_ok, len(self.known) - 1)] != uniq).any():  # started anew
                self._learn(uniq, raw, start[where], size[where], anew=True)
                pos_ok = np.searchsorted(self.known, uniq)
        slot = self.slot[pos_ok][back]
        n = self.count[slot]
        ids = self.flat[ragged(self.at[slot], n)].astype(np.int64)
        # The ids have to spell the very bytes: where two pieces share a hash they do not, and all are merged on their own.
        spelled = self._spelled(ids)
        wanted = np.insert(flat, np.cumsum(size), 32) if self.word else flat
        if not np.array_equal(spelled, wanted):
            ids, n = self._merge(self._symbols(raw, start, size), size)
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids; of a bounded group, so half as wide indices do."""
        n = self.token_len[ids].astype(np.int32)
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self.token_at[ids].astype(np.int32) - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.token_bytes[at]

    def _symbols(self, raw, start, size) -> np.ndarray:
        sym = self.first[raw[ragged(start, size)]]
        sym[np.cumsum(size) - 1] = self.last[raw[start + size - 1]]
        return sym

    def _learn(self, hashes, raw, start, size, anew=False):
        if anew or len(self.known) + len(hashes) > CACHE_PIECES:
            self._forget()
        sym, count = self._merge(self._symbols(raw, start, size), size)
        base = len(self.at)
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, sym.astype(self.flat.dtype)))
        known = np.concatenate((self.known, hashes))
        slot = np.concatenate((self.slot, base + np.arange(len(hashes))))
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as the library's encode gives them with add_special_tokens=False; null is empty."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            t = t or ""
            hit = next((s for s in self.special if s in t), None)
            if hit is None:
                parts.append(t)
                owner.append(i)
            else:
                for p in self._split(t):
                    parts.append(p)
                    owner.append(i)
        plain = [k for k, p in enumerate(parts) if isinstance(p, str)]
        out = [[] for _ in texts]
        # Groups of texts of bounded size, so that flat arrays are too; one text is never divided.
        done: dict[int, np.ndarray] = {}
        group, size = [], 0
        for k in [*plain, None]:
            if group and (k is None or size + len(parts[k]) > GROUP_CHARS):
                ids, n = self._batch([parts[g] for g in group])
                for g, x in zip(group, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    done[g] = x
                group, size = [], 0
            if k is not None:
                group.append(k)
                size += len(parts[k])
        for k, p in enumerate(parts):
            out[owner[k]].append(done[k] if isinstance(p, str) else np.array([p], np.int64))
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.int64) for x in out]

    def _split(self, text: str):
        """Plain parts (str) and ids of special tokens (int), leftmost and then longest first."""
        while True:
            found = [(text.find(s), -len(s), s) for s in self.special if s in text]
            if not found:
                if text:
                    yield text
                return
            at, _, s = min(found)
            if at:
                yield text[:at]
            yield self.special[s]
            text = text[at + len(s) :]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False; bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])].tobytes().decode("utf-8", "replace")


_open: dict[str, BatchBPE] = {}


def opened(path: str) -> BatchBPE:
    """The vocabulary of a file, read once in each Python worker."""
    if path not in _open:
        _open[path] = BatchBPE(path)
    return _open[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(docs, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of docs: ``(<id_col>, ids binary, decoded string)`` for the whole text, null being empty.

    ids holds little-endian unsigned 32-bit integers. Map-only: rows are neither moved nor grouped. An
    empty text has no ids. Nulls in id_col, repeated
    rows and other columns do not matter; only id_col and text_col are read.
    """
    from .common import bounded_batches

    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        bpe = opened(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = bpe.encode(part.column(1).to_pylist())
                packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array([bpe.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    src = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as t")
    return src.mapInArrow(run, "id bigint, ids binary, decoded string").withColumnRenamed("id", id_col)
