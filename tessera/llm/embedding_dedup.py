"""Near-duplicate vectors: a pigeonhole join over subspaces, verified exactly.

Unit vectors with cosine c lie at squared distance 2 - 2c. After a fixed random rotation, which spreads
that distance evenly, the coordinates are split into BLOCKS blocks, each with a budget in proportion to its
dimensions: if every block were over budget so would be the whole, so a link is within budget in at least one block.
Each block is joined by range: the vectors are cut into chunks of equal size along the block's first coordinate,
and a vector meets the chunks that lie within the budget's radius of it. Chunk pairs are tiles of bounded
size, evaluated with matrix products; the cosine of every candidate is then computed in double precision from the
vectors as given. A link found in several blocks counts in the first one that has it within budget.

Equal vectors are one until the end. A tile returns a count of links and one edge for each of its
vectors, never the pairs, so what leaves it grows with the vectors. The number of tiles grows with the
square of the number of chunks, less those out of range: in isotropic data of many dimensions a radius
for 0.9 spans much of a coordinate (see the README for figures).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

BLOCKS = 4
CHUNK = 16_384
_SUB = 1024
_SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def block_slices(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # no square can overflow or vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rows(column, kind: np.dtype, dim: int) -> np.ndarray:
    """The vectors of a binary column, in doubles."""
    data, first = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    flat = np.frombuffer(data, kind, len(column) * dim, int(first)) if len(column) else np.empty(0, kind)
    return flat.reshape(-1, dim).astype(np.float64)


def _close(a: np.ndarray, b: np.ndarray, budget: float):
    """Blocks of (positions in a, positions in b) with a squared distance up to budget and some slack, in single precision."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    one = lambda x: np.ones((len(x), 1), np.float32)
    # One product gives the distances: (-2a, |a|^2, 1) . (b, 1, |b|^2).
    left, right = np.hstack([-2 * a, na[:, None], one(a)]), np.hstack([b, one(b), nb[:, None]]).T.copy()
    for i in range(0, len(a), _SUB):
        d = left[i : i + _SUB] @ right
        hit = np.flatnonzero(d.ravel() <= np.float32(budget + 1e-4))
        yield i + hit // len(b), hit % len(b)


def tile_links(x: np.ndarray, y: np.ndarray, block: int, cosine: float, same: bool):
    """Links between two sets of vectors that belong to a block: (positions in x, positions in y)."""
    dim = x.shape[1]
    slices, limit = block_slices(dim), 2 - 2 * cosine
    budget = [limit * (s.stop - s.start) / dim for s in slices]
    q = rotation(dim)
    ux, uy = _unit(x), _unit(y)
    a, b = ((u @ q[:, slices[block]]).astype(np.float32) for u in (ux, uy))
    left, right = [], []
    for k in range(0, len(b), 8 * _SUB):
        for u, v in _close(a, b[k : k + 8 * _SUB], budget[block]):
            v = v + k
            if same:
                u, v = u[u < v], v[u < v]
            for at in range(0, len(u), 50_000):
                p, r = u[at : at + 50_000], v[at : at + 50_000]
                ok = np.einsum("ij,ij->i", ux[p], uy[r]) >= cosine
                p, r = p[ok], r[ok]
                diff = (ux[p] @ q - uy[r] @ q) ** 2
                first = np.full(len(p), -1)
                for j in range(len(slices) - 1, -1, -1):
                    first[diff[:, slices[j]].sum(1) <= budget[j] + _SLACK] = j
                mine = first == block
                left.append(p[mine])
                right.append(r[mine])
    empty = np.empty(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dimension_links(reps: DataFrame, kind: np.dtype, dim: int, cosine: float) -> DataFrame:
    """(rep, links, to) parts for representatives (rep, count, v) of one dimension."""
    slices, q = block_slices(dim), rotation(dim)
    radius = [math.sqrt((2 - 2 * cosine) * (s.stop - s.start) / dim) + 1e-6 for s in slices]

    def leading(batches):
        import pyarrow as pa

        for b in batches:
            x = _unit(_rows(b.column("v"), kind, dim)) @ q
            yield pa.RecordBatch.from_arrays([pa.array(x[:, s.start]) for s in slices], names=[f"c{k}" for k in range(len(slices))])

    names = [f"c{k}" for k in range(len(slices))]
    chunks = max(1, -(-reps.count() // CHUNK))
    bounds = [[] for _ in slices]
    if chunks > 1:
        # One value a chunk and block comes to the driver: 1 / CHUNK of the vectors' number.
        cuts = reps.select("v").mapInArrow(leading, ", ".join(f"{c} double" for c in names))
        bounds = cuts.approxQuantile(names, [i / chunks for i in range(1, chunks)], 0.1 / chunks)
    bounds = [np.unique(np.asarray(b, np.float64)) for b in bounds]

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            ids, counts, vs = b.column("rep").to_numpy(), b.column("count").to_numpy(), b.column("v")
            x = _unit(_rows(vs, kind, dim)) @ q
            for k, s in enumerate(slices):
                c, edge = x[:, s.start], bounds[k]
                home = np.searchsorted(edge, c, "right")
                low, high = np.searchsorted(edge, c - radius[k], "right"), np.searchsorted(edge, c + radius[k], "right")
                for far in range(int((home - low).max()), int((high - home).max()) * -1 - 1, -1):
                    # The tile of chunks home - far and home, the lower one first; side 1 is the higher.
                    ok = (home - far >= low) & (home - far <= high)
                    if not ok.any():
                        continue
                    p = np.flatnonzero(ok)
                    i, j = np.minimum(home[p], home[p] - far), np.maximum(home[p], home[p] - far)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(p), 1 if far > 0 else 0, np.int32)), pa.array(ids[p]), pa.array(counts[p]), vs.take(pa.array(p))],
                        names=["k", "i", "j", "side", "rep", "count", "v"],
                    )

    def tile(key, table):
        import pyarrow as pa

        k, i, j = (v.as_py() for v in key)
        table = table.combine_chunks()
        ids, counts, side = (table.column(c).to_numpy() for c in ("rep", "count", "side"))
        x = _rows(table.column("v").combine_chunks(), kind, dim)
        if i == j:
            a, b = tile_links(x, x, k, cosine, True)
        else:
            lo, hi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = tile_links(x[lo], x[hi], k, cosine, False) if len(lo) and len(hi) else (lo[:0], hi[:0])
            a, b = lo[a], hi[b]
        links = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        to = ids[order][smallest_reached(len(ids), rank[a], rank[b])[rank]] if len(a) else ids
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some].astype(np.int64), "to": to[some]})

    dealt = reps.select("rep", "count", "v").mapInArrow(deal, "k int, i int, j int, side int, rep bigint, count bigint, v binary")
    return dealt.groupBy("k", "i", "j").applyInArrow(tile, "rep bigint, links bigint, to bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of vectors: ``(<id_col>, n_links, component_id, kept)``.

    Vectors of the same number of dimensions are linked if their cosine, in double precision, is at least
    cosine. A vector that is null, empty, zero or holds a null, infinite or NaN component links with
    nothing: no links, its own component. So does a row with a null id, whose component is null. Rows
    that repeat an id are vectors of their own in n_links. Only the two columns are read.
    """

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                if v is None or not len(v) or None in v:
                    out.append(None)
                    continue
                x = np.asarray(v, kind)
                out.append((x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    # Vectors travel as they are stored: single precision is exact in doubles.
    kind = np.dtype(np.float32 if vectors.schema[vector_col].dataType.elementType == T.FloatType() else np.float64)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
    all_rows = src.mapInArrow(packed, "id bigint, v binary")
    good = all_rows.where("id is not null and v is not null")
    reps = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("count")))
    dims = [r["d"] for r in reps.select((F.octet_length("v") / kind.itemsize).cast("int").alias("d")).distinct().collect()]
    parts = None
    for d in sorted(dims):
        got = _dimension_links(reps.where(F.octet_length("v") == kind.itemsize * d), kind, d, cosine)
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        return src.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    parts = cut(parts)
    comp = components(parts, "rep", "to").withColumnRenamed("node", "rep")
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.join(links, "rep", "left").join(comp, "rep", "left")
    per_rep = per_rep.select("v", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = all_rows.where("id is not null and v is not null").join(per_rep, "v").select("id", "n_links", "component_id")
    alone = all_rows.where("id is null or v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
