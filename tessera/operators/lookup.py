"""First matches, key and range lookups, dictionary joins, duplicate keys, ordered positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """For each key the values of its first row by order."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("_f"), F.min(order).alias(order))
    return first.select(*keys, *[F.col(f"_f.{v}").alias(v) for v in values], order)


def key_range(index: DataFrame, key: str, lo, hi) -> DataFrame:
    """Entries with lo <= key <= hi, which reaches the scan as a filter; lo > hi gives none."""
    return index.where(F.col(key).between(lo, hi))


def resolve(rows: DataFrame, ref: str, dictionary: DataFrame, id_col: str, text_col: str, out: str = "text") -> DataFrame:
    """rows with out and ref_resolved: the dictionary's text for ref, or '#ref' where it has none. Rows are never lost."""
    names = dictionary.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = rows.join(names, F.col(ref) == F.col("_id"), "left")
    resolved = F.col("_id").isNotNull()
    return joined.withColumn(out, F.when(resolved, F.col("_text")).otherwise(F.concat(F.lit("#"), F.col(ref).cast("string")))).withColumn("ref_resolved", resolved).drop("_id", "_text")


def seek(rows: DataFrame, key: list[str], target: list, ties: list[str], n: int) -> DataFrame:
    """The n first rows at or after the target key, in order (a top-n, no full sort)."""
    after = F.lit(False)
    for i in range(len(key)):
        same = F.lit(True)
        for k, v in zip(key[:i], target[:i], strict=True):
            same = same & (F.col(k) == v)
        last = i == len(key) - 1
        after = after | (same & ((F.col(key[i]) >= target[i]) if last else (F.col(key[i]) > target[i])))
    # The leading column's bound alone reaches the scan.
    return rows.where((F.col(key[0]) >= target[0]) & after).orderBy(*key, *ties).limit(n)


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose keys occurred before, with occurrence (2, 3, ...)."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("occurrence > 1")


def histogram(rows: DataFrame, col: str, values: list[str]) -> DataFrame:
    """(col, n) for a fixed list of values, zeros included; other values are not counted."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"{col} string")
    return known.join(rows.groupBy(col).agg(F.count("*").alias("n")), col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def string_stats(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """n, total_bytes, max_bytes and empties of a text column."""
    n: Column = F.octet_length(text)
    return rows.groupBy(*keys).agg(F.count(text).alias("n"), F.sum(n).cast("long").alias("total_bytes"), F.max(n).cast("long").alias("max_bytes"), F.count_if(n == 0).alias("empties"))


def walk_chains(pages: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, hop, stopped_at, status) of chains page -> next from each start, as a recursive query.

    A chain ends where a page comes again (CYCLE), where the next page is not in pages (DANGLING_PAGE), where there
    is no next (COMPLETE), or after most hops (PAGE_LIMIT). pages is (page, next), unique by page; starts (start).
    """
    spark = pages.sparkSession
    pages.createOrReplaceTempView("_chain_pages")
    starts.createOrReplaceTempView("_chain_starts")
    return spark.sql(f"""
        with recursive chain(start, page, hop, visited, status) as (
            select start, start, 0, array(start), 'OPEN' from _chain_starts
            union all
            select c.start, coalesce(p.next, c.page), c.hop + 1, array_append(c.visited, p.next),
                case when p.next is null then 'COMPLETE' when array_contains(c.visited, p.next) then 'CYCLE'
                    when not p.there then 'DANGLING_PAGE' when c.hop + 1 >= {int(most)} then 'PAGE_LIMIT' else 'OPEN' end
            from chain c join (select a.page, a.next, b.page is not null as there from _chain_pages a left join _chain_pages b on a.next = b.page) p on c.page = p.page
            where c.status = 'OPEN')
        select start, hop, page as stopped_at, status from chain where status <> 'OPEN'""")
