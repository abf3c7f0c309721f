"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of everything.

All of it is DataFrame expressions. Prefixes are hashed only where the byte length occurs more than once, and whole
texts only where length and prefix do. Each refinement is handed to the next scan as bit maps of fixed size
(``common.SIEVE_BUCKETS`` x 4 KB, so their broadcast is bounded whatever the input). A bit set by chance costs
one needless hash and nothing else, so the result is exact. No text is ever shuffled, only ids, lengths and
hashes, and rows that are settled early are not shuffled either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew, passes, sieve, store

#: Characters of the text that the second refinement hashes.
PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None) -> DataFrame:
    """One row per row of docs: ``(<id_col>, keep_id, group_size, kept)``.

    Texts are equal when identical; null counts as the empty text. Of equal texts the row with the
    largest id stays. Rows with a null id take part (they are kept only in a group without other ids,
    whose keep_id is then null). Repeated rows with the same id count each in group_size and are all
    kept if that id is. An empty table gives an empty result; other columns are not looked at.
    digest_col names a further column with the SHA-256 of each row's text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumn("_n", F.octet_length("_t").cast("long"))
    by_length = base.groupBy("_n").count().where("count > 1").select(F.xxhash64("_n").alias("key"))
    lengths = cut(sieve(by_length))
    prefix = F.when(F.col("_maybe"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS))).alias("_p")
    hashed = passes(base, F.xxhash64("_n"), lengths).select("_id", "_t", "_n", prefix)
    by_prefix = hashed.where("_p is not null").groupBy("_n", "_p").count().where("count > 1").select(F.xxhash64("_n", "_p").alias("key"))
    prefixes = cut(sieve(by_prefix))
    whole = F.sha2(F.col("_t").cast("binary"), 256)
    full = passes(hashed, F.xxhash64("_n", "_p"), prefixes).withColumn("_open", F.col("_maybe") & F.col("_p").isNotNull())
    full = store(full.select("_id", "_open", "_n", (whole if digest_col else F.when(F.col("_open"), whole)).alias("_h")), "digests")
    rows, settled = full.where("_open"), full.where("not _open")
    groups = rows.groupBy("_n", "_h").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = rows.join(groups.select(dealt_anew(F.col("_n")).alias("_n"), "_h", "keep_id", "group_size"), ["_n", "_h"])
    out = out.select("_id", "_h", "keep_id", "group_size").unionByName(settled.select("_id", "_h", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    extra = [F.col("_h").alias(digest_col)] if digest_col else []
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"), *extra)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, drop) for common.without_rows: one document of each group of identical texts stays, in one row."""
    found = exact_dedup(docs, id_col, text_col, digest_col="h").where("group_size > 1")
    each = found.groupBy(F.col(id_col).alias("id"), "h", "kept").agg(F.count("*").alias("rows"))
    return each.where("not kept or rows > 1").select("id", F.unhex("h").alias("digest"), (~F.col("kept")).alias("drop"))
