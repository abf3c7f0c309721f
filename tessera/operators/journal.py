"""Write-ahead journals: outcomes of transactions and last-committed-wins replay, as window and aggregate plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("BEGIN", "COMMIT", "ROLLBACK")


def outcomes(ops: DataFrame, stream: list[str], order: str, op: str = "op", out: str = "outcome", chunk: int | None = None) -> DataFrame:
    """ops with a column out for every data operation: AUTO, COMMITTED, ROLLED_BACK or DROPPED; null for control ones.

    A data operation is inside a transaction if the last control operation before it is BEGIN; the next
    one decides: COMMIT, ROLLBACK (or the end of the journal), or another BEGIN, which drops what was staged.

    chunk is for streams too long for one task: windows then go over chunks of so many values of order, a whole number, and
    what a chunk cannot know comes from one row for each chunk.
    """
    control = F.when(F.col(op).isin(*CONTROL), F.col(op))
    keys = [F.col(c) for c in stream]
    if chunk is not None:
        ops = ops.withColumn("_chunk", F.call_function("div", F.col(order), F.lit(chunk).cast("long")))
        keys.append(F.col("_chunk"))
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(control, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(control, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = ops.withColumn("_before", before).withColumn("_after", after)
    if chunk is not None:
        ends = ops.where(control.isNotNull()).groupBy(*keys).agg(F.min_by(op, order).alias("_first"), F.max_by(op, order).alias("_last"))
        every = ops.select(*keys).distinct().join(ends, [*stream, "_chunk"], "left")
        v = Window.partitionBy(*stream).orderBy("_chunk")
        earlier = F.last("_last", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1))
        later = F.first("_first", ignorenulls=True).over(v.rowsBetween(1, Window.unboundedFollowing))
        edges = every.select(*stream, "_chunk", earlier.alias("_earlier"), later.alias("_later"))
        marked = marked.join(edges, [*stream, "_chunk"]).withColumn("_before", F.coalesce("_before", "_earlier")).withColumn("_after", F.coalesce("_after", "_later")).drop("_chunk", "_earlier", "_later")
    inside = F.when(F.col("_after") == "COMMIT", "COMMITTED").when(F.col("_after") == "BEGIN", "DROPPED").otherwise("ROLLED_BACK")
    done = F.when(control.isNull(), F.when(F.col("_before") == "BEGIN", inside).otherwise("AUTO"))
    return marked.withColumn(out, done).drop("_before", "_after")


def replay(ops: DataFrame, keys: list[str], order: str, deleted: Column, values: list[str]) -> DataFrame:
    """The final store: for each key the values of its last operation, unless that deletes. One aggregation, combined before the shuffle."""
    last = F.max_by(F.struct(deleted.alias("gone"), *values), F.col(order)).alias("last")
    store = ops.groupBy(*keys).agg(last, F.max(order).alias(order)).where("not last.gone")
    return store.select(*keys, *[F.col(f"last.{v}").alias(v) for v in values], order)
