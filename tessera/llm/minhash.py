"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

A document is its set of distinct k-word shingles, as 64-bit hashes. The hash range is divided into BINS bins; the
signature holds the least hash of each bin, and an empty bin takes that of the first filled bin in a
random order of its own. BANDS keys of ROWS values each put a document into buckets. Documents with
equal sets are one from here on.

Candidates come in two rounds, and every candidate link is confirmed on the full sets. The first is a star
in each bucket: the centre is the document with the largest buckets over all bands (the one most others
resemble), and it is compared with all others. The second finishes, exactly and whatever their size, all
buckets that then still hold documents of several components: a prefix filter over their documents.
Shingles are ordered from rare to frequent; of two sets that are alike enough, the rarest common shingle
is among the first few of both, how many follows from the sizes and the threshold. So what many share
(a licence, a template) gives no candidates, no linked pair of an open bucket is passed over unless the
two are already connected, and pairs are not in proportion to the squares of the buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _mix, _powers
from .common import bounded_batches, components, cut, dealt_anew, passes, row_digest, sieve, small_batches, store

BINS, BANDS, ROWS = 96, 24, 4
#: Counters that stand for the frequencies of shingles; where they are shared, the order is less sharp and the pairs the same.
SLOTS = 1 << 18
#: Rows with texts or sets in one Arrow batch. Everything that runs in Python is written before the result is returned.
ARROW_ROWS = 500

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.array([-(-(b << 64) // BINS) for b in range(BINS)], np.uint64)
_ORDERS = np.stack([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k consecutive words, or all of them if fewer; empty without words.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z in lower case.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(start):
        return [np.empty(0, np.uint64) for _ in texts]
    stop = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    size = stop - start
    flat = _LOWER[raw[~space]]
    at = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        local = np.arange(len(flat)) - np.repeat(at, size)
        word = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[local], at)
        word = _mix(word + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.searchsorted(start, np.concatenate(([0], ends[:-1])))
        last = np.append(first[1:], len(start))
        run = word.copy()
        for i in range(1, k):
            run = _mix(run[: len(word) - i] * _P + word[i:]) if len(word) > i else run[:0]
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = _mix(h * _P + w)
                out.append(np.array([_mix(h + np.uint64(k))], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The BINS values of a sorted, non-empty set."""
    at = np.searchsorted(s, _EDGES)
    filled = at < np.append(at[1:], len(s))
    sig = s[np.minimum(at, len(s) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDERS[empty]
        sig[empty] = sig[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for v in sig.reshape(BANDS, ROWS).T:
            h = _mix(h * _P + v)
    return h.view(np.int64)


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _in_parts(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(src: DataFrame, k: int) -> DataFrame:
    """(id, row, n, digest, keys) of the rows (id, row, t): set size, 128-bit hash of the set, band keys (none for the empty set)."""

    def run(batches):
        import pyarrow as pa

        for part in _in_parts(batches, 128):
            sets = shingle_sets(_texts(part.column(2)), k)
            keys = [band_keys(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets]
            columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n", "digest", "keys"])

    return src.mapInArrow(run, "id bigint, row binary, n bigint, digest binary, keys array<bigint>")


def _sets_of(src: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, s): the packed sets of wanted: (node, id, digest). A sieve of the ids keeps most other texts from being read in Python."""

    def run(batches):
        import pyarrow as pa

        for part in _in_parts(batches, 128):
            sets = shingle_sets(_texts(part.column(1)), k)
            columns = [part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "s"])

    bits = sieve(wanted.select(F.xxhash64("id").alias("key")))
    some = passes(src, F.xxhash64("id"), bits).where("_maybe").select("id", "t")
    rows = some.mapInArrow(run, "id bigint, digest binary, s binary").alias("r")
    same = (F.col("r.digest") == F.col("w.digest")) & F.col("r.id").eqNullSafe(F.col("w.id"))
    # Rows that repeat an id and a set give the set again; one will do.
    return rows.join(wanted.alias("w"), same).groupBy("node").agg(F.first("s").alias("s"))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union|."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(both) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in sets.s, in SLOTS counters by their low bits."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(SLOTS, np.int64)
        for part in _in_parts(batches, 64):
            tokens = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
            total += np.bincount((tokens & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    got = sets.select("s").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _prefixes(held: DataFrame, often: np.ndarray, num: int, den: int) -> DataFrame:
    """(node, c, n, token, at, low) for the first shingles of each set in (node, c, s), rare ones first.

    At least num / den of a set's n shingles are common to any set it is linked with, so the first common one is among
    the first n - ceil(n * num / den) + 1; low marks those that suffice where the other set is not smaller.
    """

    def run(batches):
        import pyarrow as pa

        names = ["node", "c", "n", "token", "at", "low"]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                first, size, cut_low = [], [], []
                for v in part.column(2):
                    s = np.frombuffer(v.as_buffer(), np.uint64)
                    n = len(s)
                    order = np.lexsort((s, often[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))
                    first.append(s[order[: n + (-n * num // den) + 1]].view(np.int64))
                    size.append(n)
                    cut_low.append(n + (-2 * n * num // (den + num)) + 1)
                each = np.array([len(f) for f in first])
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                rows = np.repeat(np.arange(part.num_rows), each)
                columns = [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(np.array(size)[rows], pa.int64()), pa.array(np.concatenate(first), pa.int64()), pa.array(at, pa.int64()), pa.array(at < np.array(cut_low)[rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.select("node", "c", "s").mapInArrow(run, "node bigint, c bigint, n bigint, token bigint, at bigint, low boolean")


def _alike(held: DataFrame, often: np.ndarray, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components c in (node, c, s), all those with den * |intersection| >= num * |union| among them."""
    first = store(_prefixes(held, often, num, den), "prefixes")
    x = first.where("low").select("token", *[F.col(k).alias(f"x_{k}") for k in ("node", "c", "n", "at")])
    y = first.select("token", *[F.col(k).alias(f"y_{k}") for k in ("node", "c", "n", "at")])
    # x is the smaller set. From the first common shingle on, both must still have as many as the intersection needs.
    smaller = "(x_n < y_n or x_n = y_n and x_node < y_node)"
    enough = f"x_n * {den} >= y_n * {num} and {den + num} * least(x_n - x_at, y_n - y_at) >= {num} * (x_n + y_n)"
    both = x.join(y, "token").where(f"x_c <> y_c and {smaller} and {enough}")
    return both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: ``(<id_col>, n_shingles, component_id, kept)``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id that links reach, kept whether it is the row's own. Null or empty texts and texts of
    white space have 0 shingles and are linked with nothing. Texts of fewer words than a shingle are linked
    with equal word sequences only. Every row is judged by its own text: rows that repeat an id may differ in
    component_id. Rows with a null id take part like all others; a component without any id has a null
    component_id, and its rows are all kept. Only the two columns are read; an empty table gives no rows.
    """
    out = grouped(docs, id_col, text_col, words, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, digest, drop) for common.without_rows: the first document of each group of near-duplicates stays, in one row.

    First is the smallest id, of equal ids the smallest digest; a null id comes after all others.
    """
    each = grouped(docs, id_col, text_col, words, percent).where("node is not null").groupBy("node", "id", "row").agg(F.count("*").alias("rows"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = each.groupBy("node").agg(F.min(place).alias("first"), F.sum("rows").alias("all")).where("all > 1").select(dealt_anew(F.col("node")).alias("node"), "first")
    found = each.join(first, "node").withColumn("drop", ~place.eqNullSafe(F.col("first")))
    return found.where("drop or rows > 1").select("id", F.col("row").alias("digest"), "drop")


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, row, n, node, component_id) for each row: row_digest, set size, group of the near-duplicates (null for empty sets)."""
    with small_batches(docs.sparkSession, ARROW_ROWS):
        return _grouped(docs, id_col, text_col, words, percent)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    src = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), row_digest(F.col(text_col)).alias("row"), F.col(text_col).alias("t"))
    sig = store(signatures(src, words), "signatures")
    # A node is a distinct set: its number exists once the table is written.
    sets = sig.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = store(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    buckets = reps.select("node", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(dealt_anew(F.col("key")).alias("key"), "size")
    rows = store(buckets.join(shared, "key"), "buckets")
    weight = rows.groupBy("node").agg(F.sum("size").alias("weight")).select(dealt_anew(F.col("node")).alias("node"), "weight")
    best = F.max(F.struct("weight", F.col("node").alias("centre"), F.col("n").alias("m"))).alias("best")
    centres = rows.join(weight, "node").groupBy("key").agg(best).select(dealt_anew(F.col("key")).alias("key"), "best.centre", "best.m")
    # Sizes alone settle many: the smaller set must have percent of the larger one.
    pairs = rows.join(centres, "key").where((F.col("node") != F.col("centre")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    pairs = cut(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    held = rows.select("node").distinct().join(reps.select("node", "id", "digest"), "node")
    texts = store(_sets_of(src.select("id", "t"), cut(held), words), "texts")
    star = components(_confirmed(pairs, texts, percent, 100))
    named = rows.join(star.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(dealt_anew(F.col("key")).alias("key"))
    left = cut(named.join(several, "key", "left_semi").select("node", "c").distinct())
    more = _alike(texts.join(left, "node"), _frequencies(texts), percent, 100)
    found = _confirmed(more.join(pairs, ["a", "b"], "left_anti"), texts, percent, 100)
    # The components of the first round are the nodes of the second.
    ends = found.join(left.select(F.col("node").alias("a"), F.col("c").alias("u")), "a").join(left.select(F.col("node").alias("b"), F.col("c").alias("v")), "b")
    above = components(ends, "u", "v").select(F.col("node").alias("c"), F.col("component").alias("above"))
    group = reps.select("digest", "node", "id").join(star.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    group = group.join(above, "c", "left").select("digest", "id", F.coalesce("above", "c").alias("node"))
    names = group.groupBy("node").agg(F.min("id").alias("component_id"))
    named = cut(group.select("digest", "node").join(names.select(dealt_anew(F.col("node")).alias("node"), "component_id"), "node"))
    # Rows without words share no group and go no further; the others meet their set, of which many may be copies.
    full = sig.where("n > 0").join(named, "digest").select("id", "row", "n", "node", "component_id")
    empty = sig.where("n = 0").select("id", "row", "n", F.lit(None).cast("long").alias("node"), F.col("id").alias("component_id"))
    return full.unionByName(empty)
