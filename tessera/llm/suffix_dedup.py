"""Repeated substrings: suffixes are told apart by most-significant-digit passes, no deeper than the threshold.

Two suffixes share their first LENGTH bytes exactly if MSD radix passes to that depth leave them in one group. Moving
every suffix of a corpus from pass to pass would move it many times over, so one suffix stands for its neighbours
until the passes get so deep that they differ:

1. Each window of LENGTH bytes names one of its GRAM-byte grams, the least in a hash order, leftmost on ties. Equal
   windows name equal grams, and neighbouring windows mostly name the same one: a *run*. The first digit is that gram.
   Runs whose gram occurs once in the corpus hold no repeated window and are done.
2. The second digit is the whole run. A run that occurred before is repeated in full, and only the first of equal runs
   goes on, if other runs share its gram.
3. The third digit is a run's core: a run is cut where the distance of the windows from their gram is a multiple of BLOCK,
   and the core is what all windows of such a piece share, LENGTH - BLOCK + 1 bytes. Pieces whose core occurs
   once are done. The fourth digit is the whole piece, as the second is the whole run.
4. The last digit is the window's LENGTH bytes. Equal groups are exactly the repeated windows, and all but the first
   place of each are removed.

The first and the third digit only decide what goes on, and are 64-bit hashes. The others decide what is removed, and are
128-bit BLAKE2 digests of the very bytes.

Groups are never gathered: each pass keeps, for a digit, only a count or the first place, aggregated
before the shuffle, and a join hands it back. What one task holds is bounded by a document's own length, and texts
are read CHUNK bytes at a time.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _mix, ragged
from .common import bounded_batches, cut, dealt_anew, discard, passes, sieve, store

LENGTH, GRAM, BLOCK = 100, 32, 16
#: Words of 64 bits of the map that holds the repeated grams: 16 MB, whatever the input.
SIEVE_WORDS = 1 << 21
#: Shares in which windows are compared, by a digit of their digest.
SHARES = 2
#: Bytes whose suffixes are looked at together: of one text or of several.
CHUNK = 1 << 17
#: Texts taken from a batch at a time.
PART = 256
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
_NULL_ID = -(2**63)
_tables: dict = {}


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _tables.get("p")
    if got is None or len(got[0]) < n:
        size = max(2 * n, 1 << 16)
        got = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_B, _BI))
        _tables["p"] = got
    return got


class Hashed:
    """Hashes of any substrings of some bytes, from one pass of prefix sums."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        p, self.inverse = _power_pair(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * p[: self.n], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        """Of all substrings of a size, in order."""
        return _mix((self.sums[size:] - self.sums[: self.n - size + 1]) * self.inverse[: self.n - size + 1])


def runs(raw: bytes, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hashed, first window, windows, place of the gram, gram hash, part) of all runs in the parts of raw that begin at starts.

    Every part has at least length bytes; no window goes over its end.
    """
    n = len(raw)
    h = Hashed(raw)
    grams = h.all(gram)
    # Hash order in the high half, place in the low one: the least is the leftmost of the least.
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    # A run begins with a part, and where another gram is named; what begins behind a part's last window is none.
    stop = np.append(starts[1:], n) - length + 1
    other = np.flatnonzero(low[1:] != low[:-1]) + 1
    part = np.searchsorted(starts, other, "right") - 1
    other = other[(other > starts[part]) & (other < stop[part])]
    first = np.sort(np.concatenate((starts, other)))
    part = np.searchsorted(starts, first, "right") - 1
    count = np.minimum(np.append(first[1:], n), stop[part]) - first
    named = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h, first, count, named, grams[named], part


def _together(texts: list, length: int):
    """(bytes, starts, row, offset) of parts of texts, joined to about CHUNK bytes; a part is a text, or CHUNK windows of one."""
    held, size = [], 0

    def out():
        starts = np.cumsum([0, *[len(p) for _, _, p in held[:-1]]])
        return b"".join([p for _, _, p in held]), starts, np.array([i for i, _, _ in held]), np.array([at for _, at, _ in held])

    for i, t in enumerate(texts):
        raw = _bytes(t)
        for at in range(0, max(len(raw) - length + 1, 0), CHUNK):
            part = raw[at : at + CHUNK + length - 1]
            if held and size + len(part) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield out()


def cores(h: Hashed, first, count, gram_at, length: int, block: int):
    """(run, block, hash) of the pieces of the runs, in order.

    Block b of a run holds the windows that begin b * block to (b + 1) * block - 1 bytes before the gram. All of them, in
    whatever run, hold the length - block + 1 bytes from b * block before the gram on.
    """
    near, far = (gram_at - first - count + 1) // block, (gram_at - first) // block
    each = far - near + 1
    run = np.repeat(np.arange(len(first)), each)
    b = np.repeat(far + 1, each) - 1 - ragged(np.zeros(len(first), np.int64), each)
    at = gram_at[run] - b * block
    core = h.of(at, at + length - block + 1)
    return run, b, _mix(core + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _digests(raw: bytes, start, stop) -> np.ndarray:
    """The 128-bit digests of raw[start:stop], as two int64 columns."""
    blake = hashlib.blake2b
    whole = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(whole, np.int64).reshape(-1, 2)


def _flat(batches, names: list[str], made):
    """Record batches of the columns that made(batch) yields for PART rows at a time."""
    import pyarrow as pa

    with np.errstate(over="ignore"):
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                for columns in made(batch.slice(k, PART)):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _bytes(t) -> bytes:
    return (t or "").encode()


def _place(start: Column) -> Column:
    """Document and start as one number, which orders as they do; unlike a struct, it is aggregated by hash."""
    return F.col("d").cast("decimal(20,0)") * F.lit(1 << 32) + start.cast("decimal(10,0)")


def _gram_map(repeated: DataFrame) -> np.ndarray:
    """A map of SIEVE_WORDS words with a bit for each of repeated.g, on the driver."""
    at = F.pmod("g", F.lit(SIEVE_WORDS * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = repeated.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SIEVE_WORDS, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _repeated(rows: DataFrame, digit: list[str], start: Column) -> DataFrame:
    """(digit..., f): the first place of each digit that rows hold more than once."""
    first = rows.groupBy(*digit).agg(F.min(_place(start)).alias("f"), F.count("*").alias("c")).where("c > 1")
    return first.select(dealt_anew(F.col(digit[0])).alias(digit[0]), *digit[1:], "f").hint("shuffle_hash")


def _judged(rows: DataFrame, digit: list[str], start: str) -> DataFrame:
    """rows without the digit, and with later: whether it has an earlier place."""
    marked = rows.join(_repeated(rows, digit, F.col(start)), digit, "left")
    return marked.withColumn("later", F.coalesce(_place(F.col(start)) > F.col("f"), F.lit(False))).drop(*digit, "f")


def _more_than_one(rows: DataFrame, digit: str) -> DataFrame:
    """The rows whose digit occurs more than once."""
    again = rows.groupBy(digit).count().where("count > 1").select(dealt_anew(F.col(digit)).alias(digit))
    return rows.join(again.hint("shuffle_hash"), digit)


def covers(src: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(d, k, lo, hi): all windows lo to hi of document (d, k) occur at an earlier place. src is (d, k, t)."""
    spark = src.sparkSession

    def first_digits(batches):
        def made(part):
            for raw, starts, _, _ in _together(part.column(0).to_pylist(), length):
                yield [runs(raw, starts, length, gram)[4].view(np.int64)]

        yield from _flat(batches, ["g"], made)

    repeated = src.select("t").mapInArrow(first_digits, "g bigint").groupBy("g").count().where("count > 1")
    bits = spark.sparkContext.broadcast(_gram_map(repeated))

    def second_digits(batches):
        import pyarrow as pa

        known = bits.value

        def made(part):
            d, k = (part.column(i).to_numpy() for i in (0, 1))
            for raw, starts, row, offset in _together(part.column(2).to_pylist(), length):
                h, *found = runs(raw, starts, length, gram)
                slot = found[3] & np.uint64(SIEVE_WORDS * 64 - 1)
                some = (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                first, count, gram_at, g, of = (x[some] for x in found)
                digest = _digests(raw, first, first + count - 1 + length)
                run, _, core = cores(h, first, count, gram_at, length, block)
                ends = np.searchsorted(run, np.arange(len(first) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(core.view(np.int64)))
                yield [d[row[of]], k[row[of]], first - starts[of] + offset[of], count.astype(np.int32), (gram_at - first).astype(np.int32), g.view(np.int64), digest[:, 0], digest[:, 1], lists]

        yield from _flat(batches, ["d", "k", "s", "n", "o", "g", "r1", "r2", "cores"], made)

    rows = store(src.mapInArrow(second_digits, "d bigint, k bigint, s bigint, n int, o int, g bigint, r1 bigint, r2 bigint, cores array<bigint>"), "runs")
    judged = _judged(rows, ["r1", "r2"], "s")
    judged = store(judged.withColumn("cores", F.when(~F.col("later"), F.col("cores"))), "judged")
    bits.destroy()
    discard(rows)
    full = judged.where("later").select("d", "k", F.col("s").alias("lo"), (F.col("s") + F.col("n") - 1).alias("hi"))
    # The windows of a piece: those of its run that are in its block; blocks come in falling order.
    pieces = _more_than_one(judged.where("not later").drop("later"), "g").select("d", "k", "s", "n", "o", F.posexplode("cores").alias("i", "core"))
    b = F.shiftright("o", int(np.log2(block))) - F.col("i")
    lo = F.greatest(F.col("s"), F.col("s") + F.col("o") - (b + 1) * block + 1)
    hi = F.least(F.col("s") + F.col("n") - 1, F.col("s") + F.col("o") - b * block)
    pieces = _more_than_one(pieces.select("d", "k", lo.alias("lo"), hi.alias("hi"), "core"), "core")
    wanted = store(pieces.groupBy("d", "k").agg(F.collect_list(F.struct("lo", "hi", "core")).alias("pieces")), "wanted")

    def last_digits(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        blake = hashlib.blake2b

        def made(part):
            lists, texts = part.column(3), part.column(2).to_pylist()
            flat, row = lists.flatten(), np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            lo, hi, core = (flat.field(i).to_numpy() for i in range(3))
            raw, of, windows, whole = b"", -1, [], []
            for i, a, z in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if i != of:
                    raw, of = _bytes(texts[i]), i
                digests = b"".join([blake(raw[s : s + length], digest_size=16).digest() for s in range(a, z + 1)])
                windows.append(digests)
                whole.append(blake(digests, digest_size=16).digest())
            ends = np.concatenate(([0], np.cumsum(2 * (hi - lo + 1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(windows), np.int64)))
            piece = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            d, k = (part.column(i).to_numpy() for i in (0, 1))
            yield [d[row], k[row], lo, hi, core, piece[:, 0], piece[:, 1], lists]

        yield from _flat(batches, ["d", "k", "lo", "hi", "core", "p1", "p2", "w"], made)

    row = F.xxhash64("d", "k")
    maybe = passes(src, row, cut(sieve(wanted.select(row.alias("key"))))).where("_maybe").select("d", "k", "t")
    pieces = store(maybe.join(wanted, ["d", "k"]).mapInArrow(last_digits, "d bigint, k bigint, lo bigint, hi bigint, core bigint, p1 bigint, p2 bigint, w array<bigint>"), "pieces")
    discard(wanted)
    judged = _judged(pieces, ["p1", "p2"], "lo")
    judged = store(judged.withColumn("w", F.when(~F.col("later"), F.col("w"))), "judged")
    discard(pieces)
    parts = [full, judged.where("later").select("d", "k", "lo", "hi")]
    window = F.transform(F.sequence(F.lit(0), (F.col("hi") - F.col("lo")).cast("int")), lambda i: F.struct((F.col("lo") + i).alias("s"), F.get("w", 2 * i).alias("w1"), F.get("w", 2 * i + 1).alias("w2")))
    win = _more_than_one(judged.where("not later"), "core").select("d", "k", F.explode(window).alias("x")).select("d", "k", "x.*")
    win = store(win, "windows")
    for i in range(SHARES):  # one leading digit at a time, so that no pass shuffles all windows
        again = _judged(win.where(F.pmod("w1", F.lit(SHARES)) == i), ["w1", "w2"], "s").where("later")
        parts.append(store(again.select("d", "k", F.col("s").alias("lo"), F.col("s").alias("hi")), "single"))
    discard(win)
    return functools.reduce(DataFrame.unionByName, parts)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: ``(<id_col>, n_bytes, removed array<struct<start, end>>, kept binary)``.

    Texts are UTF-8 bytes, null being empty. A byte is removed if a string of length bytes that covers it
    also starts earlier: in a row with a smaller id, or in one with the same id at a smaller offset. removed lists the
    maximal runs in order, kept is what is left. Texts shorter than length lose nothing. A null id counts as the
    smallest of all. Of rows that repeat an id each is judged by its own text: equal offsets in them do not count
    as earlier, and rows that repeat the text as well get equal results. Only the two columns are read; an empty
    table gives no rows. block has to be a power of two, with gram + block - 1 <= length.
    """
    if block & (block - 1) or gram + block - 1 > length:
        raise ValueError("block has to be a power of two, with gram + block - 1 <= length")
    # A row is known by its id and a hash of its text, which only has to tell rows with one id apart.
    src = bounded_batches(docs).select(F.col(id_col).alias("i"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), F.col(text_col).alias("t"))
    found = covers(src.select("d", "k", "t"), length, gram, block)
    per_row = store(found.groupBy("d", "k").agg(F.collect_list(F.struct("lo", "hi")).alias("covers")), "covers")

    def remove(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                part = batch.slice(k, PART)
                n_bytes, removed, kept = [], [], []
                for t, c in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    raw = _bytes(t)
                    if not c.is_valid:
                        n_bytes.append(len(raw))
                        removed.append([])
                        kept.append(raw)
                        continue
                    lo, hi = (np.asarray(c.values.field(i)) for i in (0, 1))
                    edge = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(hi + length, minlength=len(raw) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    step = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    n_bytes.append(len(raw))
                    removed.append([{"start": a, "end": e} for a, e in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)])
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                columns = [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "n_bytes", "removed", "kept"])

    spans = "array<struct<start:bigint,end:bigint>>"
    row = F.xxhash64("d", "k")
    split = passes(src, row, cut(sieve(per_row.select(row.alias("key")))))
    # A row let through by chance has no covers.
    touched = split.where("_maybe").join(per_row, ["d", "k"], "left").select("i", "t", "covers")
    changed = touched.mapInArrow(remove, f"i {src.schema['i'].dataType.simpleString()}, n_bytes bigint, removed {spans}, kept binary")
    text = F.coalesce("t", F.lit(""))
    clean = split.where("not _maybe").select("i", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast(spans).alias("removed"), text.cast("binary").alias("kept"))
    return changed.unionByName(clean).withColumnRenamed("i", id_col)
