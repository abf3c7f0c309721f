"""Positions of regular-expression matches as plain column expressions.

Spark's functions return the texts of matches, not their places. Splitting at the same pattern gives
the texts between them, and the running length of both is the place, in code points. Running sums are made by
doubling, so that time grows with n log n in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in a block of a text that is cut up to be put together anew.
BLOCK = 2048


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, join, nothing: Column) -> Column:
    """array of join over all values up to each place, for a join that is associative with nothing as its neutral value."""

    def double(a, k):
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: join(x, F.when(i >= back, F.get(a, i - back)).otherwise(nothing)))

    rounds = F.filter(F.array(*[F.lit(k) for k in range(31)]), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(values))
    return F.aggregate(rounds, values, double)


def located(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start, end, m, g1..>> of all leftmost non-overlapping matches; ends exclusive."""
    hits = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    names = ["m", *[f"g{i + 1}" for i in range(len(groups))]]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *[h.alias(n) for n, h in zip(names, hits, strict=True)])
    kinds = "array<struct<start:bigint,end:bigint,m:string" + "".join(f",{n}:string" for n in names[1:]) + ">>"

    def place(pairs):
        size = F.transform(pairs, lambda x: (F.char_length(x["gap"]) + F.char_length(x["m"])).cast("long"))
        one = lambda x, end: F.struct((end - F.char_length(x["m"])).alias("start"), end.alias("end"), *[x[n].alias(n) for n in names])
        return _bound(running(size, lambda a, b: a + b, F.lit(0).cast("long")), lambda ends: F.transform(pairs, lambda x, i: one(x, F.get(ends, i))))

    # The text after the last match has no match of its own.
    found = _bound(F.filter(zipped, lambda x: x["m"].isNotNull()), place)
    return F.when(text.rlike(pattern), found.cast(kinds)).otherwise(F.array().cast(kinds))


def rewritten(text: Column, spans: Column, replacement) -> Column:
    """text with each span (sorted by start) replaced by replacement(span); of overlapping ones the first one's is taken for all."""

    def between(blocks, a, b):
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        in_first, in_last = F.pmod(a, F.lit(BLOCK)).cast("int"), F.pmod(b, F.lit(BLOCK)).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        whole = F.concat(F.substring(block(first), in_first + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), in_last))
        return F.when(first == last, F.substring(block(first), in_first + 1, in_last - in_first)).otherwise(whole)

    def build(blocks):
        def piece(x, at):
            return F.when(x["start"] >= at, F.concat(between(blocks, at, x["start"]), replacement(x))).otherwise("")

        def over(ends):
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))
            tail = between(blocks, F.element_at(ends, -1), F.char_length(text).cast("long"))
            return F.concat(F.array_join(F.transform(spans, lambda x, i: piece(x, before(i))), ""), tail)

        ends = running(F.transform(spans, lambda x: x["end"].cast("long")), F.greatest, F.lit(0).cast("long"))
        return _bound(ends, over)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _bound(blocks, build)).otherwise(text)
