"""Sequence numbers, byte ranges, runs and flow control over ordered streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 65_536


def observe(frames: DataFrame, stream: list[str], order: str, seq: str, reset: Column, chunk: int | None = None) -> DataFrame:
    """frames with booleans is_dup, is_gap, is_reset. A reset re-seeds the stream with the frame after it.

    chunk is for streams too long for one task: windows then go over chunks of so many values of order, a whole number, and
    each chunk's last frame is handed to the next chunk.
    """
    frames = frames.withColumn("is_reset", reset)
    keys = [F.col(c) for c in stream]
    if chunk is not None:
        frames = frames.withColumn("_chunk", F.call_function("div", F.col(order), F.lit(chunk).cast("long")))
        keys.append(F.col("_chunk"))
    # A frame is compared with the one before it, unless that was a reset.
    seen = F.struct(F.col(seq).alias("seq"), F.col("is_reset").alias("reset"))
    marked = frames.withColumn("_prev", F.lag(seen).over(Window.partitionBy(*keys).orderBy(order)))
    if chunk is not None:
        ends = frames.groupBy(*keys).agg(F.max_by(seen, order).alias("_end"))
        edges = ends.select(*stream, "_chunk", F.lag("_end").over(Window.partitionBy(*stream).orderBy("_chunk")).alias("_end"))
        marked = marked.join(edges, [*stream, "_chunk"]).withColumn("_prev", F.coalesce("_prev", "_end")).drop("_chunk", "_end")
    prev = F.when(~F.col("_prev.reset"), F.col("_prev.seq"))
    dup = F.coalesce(F.col(seq) == prev, F.lit(False))
    gap = F.coalesce((F.col(seq) != prev) & (F.col(seq) != (prev + 1) % MODULUS), F.lit(False))
    return marked.withColumn("is_dup", dup).withColumn("is_gap", gap).drop("_prev")


def stream_stats(observed: DataFrame, stream: list[str]) -> DataFrame:
    """frames, gaps, dups and resets of each stream."""
    flags = (("gaps", "is_gap"), ("dups", "is_dup"), ("resets", "is_reset"))
    return observed.groupBy(*stream).agg(F.count("*").alias("frames"), *[F.count_if(F.col(c)).alias(n) for n, c in flags])


def coalesce_ranges(ranges: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): the union of half-open ranges, touching or overlapping ones merged; empty ones ignored."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0)
    islands = ranges.where(F.col(lo) < F.col(hi)).withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_island")


def complete(islands: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """(keys, islands, length, is_complete): complete if one island begins at 0.

    total names a column of islands with the length a final fragment has set, null where none came: then a message is
    complete if its length is 0, or one island goes from 0 at least that far.
    """
    whole = (F.count("*") == 1) & (F.min("lo") == 0)
    if total is not None:
        end = F.max(total)
        whole = end.isNotNull() & ((end == 0) | (whole & (F.max("hi") >= end)))
    return islands.groupBy(*keys).agg(F.count("*").alias("islands"), F.max("hi").alias("length"), whole.alias("is_complete"))


def final_lengths(fragments: DataFrame, keys: list[str], order: str, end: str, fin: Column) -> DataFrame:
    """(keys, total): the highest end that had come when the last final fragment did; null where none did."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    reach = fragments.withColumn("_reach", F.max(end).over(w))
    return reach.groupBy(*keys).agg(F.max_by(F.when(fin, F.col("_reach")), F.when(fin, F.col(order))).alias("total"))


def whole_messages(parts: DataFrame, keys: list[str], number: str, amount: str) -> DataFrame:
    """(keys, fragments, total) of the messages of which all fragments 1 to the highest number are there, each once."""
    whole = parts.groupBy(*keys).agg(F.count("*").alias("fragments"), F.sum(amount).alias("total"), F.max(number).alias("_fin"))
    return whole.where("fragments = _fin").drop("_fin")


def decode_counters(frames: DataFrame, keys: list[str], kind: str = "type", crc_ok: Column | None = None, **names: str) -> DataFrame:
    """(keys, frames, control, acks, resets, crc_ok, crc_bad): what a decoder counts. Names map a counter to the value of kind."""
    names = {"control": "CONTROL", "acks": "ACK", "resets": "RESET"} | names
    ok = F.col("crc_ok") if crc_ok is None else crc_ok
    counts = [F.count_if(F.col(kind) == v).alias(n) for n, v in names.items()]
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), *counts, F.count_if(ok).alias("crc_ok"), F.count_if(~ok).alias("crc_bad"))


def runs(rows: DataFrame, stream: list[str], order: str, value: str, cap: int) -> DataFrame:
    """(stream, value, first, n): maximal runs of equal values, split after cap rows."""
    w = Window.partitionBy(*stream).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    islands = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy(*stream, "_run").orderBy(order))
    parts = islands.withColumn("_part", F.floor((rank - 1) / cap))
    return parts.groupBy(*stream, "_run", "_part", value).agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("_run", "_part")


def flow_control(events: DataFrame, stream: list[str], order: str, window: Column, send: Column) -> DataFrame:
    """events with sent (so far), admitted and blocked.

    window is the ceiling an update advertises (null for none; it never shrinks), send the bytes asked
    for (0 for none). sent_t = min(sent_{t-1} + n_t, ceiling_t) is closed to a running minimum:
    with S the running sum of n, sent_t = S_t + min(0, min over s <= t of ceiling_s - S_s).
    """
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("_n", send).withColumn("_adv", F.coalesce(F.max(window).over(w), F.lit(0))).withColumn("_s", F.sum("_n").over(w))
    out = out.withColumn("sent", F.col("_s") + F.least(F.lit(0), F.min(F.col("_adv") - F.col("_s")).over(w)))
    before = F.coalesce(F.lag("sent").over(Window.partitionBy(*stream).orderBy(order)), F.lit(0))
    out = out.withColumn("admitted", F.col("sent") - before).withColumn("blocked", F.col("admitted") < F.col("_n"))
    return out.drop("_n", "_adv", "_s")


def ordered_delivery(messages: DataFrame, stream: list[str], msg: str, arrival: str) -> DataFrame:
    """messages with is_dup and released_at, for an unbounded window and dense ids.

    The first arrival sets the cursor; ids below it are duplicates, and message m is released once all
    from the cursor to m have arrived: at the running maximum of arrivals in id order.
    """
    cursor = F.min_by(msg, arrival).over(Window.partitionBy(*stream))
    out = messages.withColumn("is_dup", F.col(msg) < cursor)
    reach = F.max(F.when(~F.col("is_dup"), F.col(arrival))).over(Window.partitionBy(*stream).orderBy(msg).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("released_at", F.when(~F.col("is_dup"), reach))


def fragments(rows: DataFrame, data: str, size: int) -> DataFrame:
    """rows exploded into pieces of at most size characters or bytes: frag_idx, frag_offset, fragment, is_fin; an empty one is a single piece."""
    n = F.length(data)
    pieces = F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    out = rows.withColumn("_k", pieces).withColumn("frag_idx", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    out = out.withColumn("frag_offset", F.col("frag_idx") * size)
    return out.withColumn("fragment", F.substring(data, F.col("frag_offset") + 1, F.lit(size))).withColumn("is_fin", F.col("frag_idx") == F.col("_k") - 1).drop("_k")
