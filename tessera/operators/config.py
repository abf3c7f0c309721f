"""Flattened configuration: differences of two snapshots and validation against rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_values(flat: DataFrame, path: list[str], value: str, ordinal: str) -> DataFrame:
    """One row a path: the value of the last entry."""
    return flat.groupBy(*path).agg(F.max_by(value, ordinal).alias(value))


def diff(before: DataFrame, after: DataFrame, path: str, value: str, ordinal: str | None = None) -> DataFrame:
    """(path, kind, old, new) with kind REMOVED, ADDED or CHANGED; a full outer equi-join on paths.

    With ordinal, of entries that repeat a path the last one counts, and the result is ordered: REMOVED as in before, then
    ADDED and CHANGED as in after, each path at its first entry. Without, paths have to be unique on each side.
    """

    def side(rows, name, at):
        if ordinal is None:
            return rows.select(F.col(path), F.col(value).alias(name), F.lit(0).alias(at))
        return rows.groupBy(path).agg(F.max_by(value, ordinal).alias(name), F.min(ordinal).alias(at))

    both = side(before, "old", "_a").join(side(after, "new", "_b"), path, "full")
    kind = F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED").when(~F.col("old").eqNullSafe(F.col("new")), "CHANGED")
    out = both.withColumn("kind", kind).where("kind is not null")
    if ordinal is not None:
        out = out.orderBy(F.col("kind") != "REMOVED", F.coalesce("_b", "_a"), path)
    return out.select(path, "kind", "old", "new")


def flatten_map(rows: DataFrame, keys: list[str], props: str) -> DataFrame:
    """(keys, path, text): the members of a JSON object of scalars, as flattened configuration has them."""
    return rows.select(*keys, F.explode(F.from_json(props, "map<string,string>")).alias("path", "text"))


class Schema:
    """Rules on columns (or resolved paths), checked row by row; each adds kinds of violations."""

    def __init__(self):
        self.rules: list[tuple[str, str, object]] = []

    def require(self, name: str) -> Schema:
        self.rules.append((name, "MISSING_REQUIRED", F.col(name).isNull()))
        return self

    def at_least(self, name: str, low) -> Schema:
        self.rules.append((name, "BELOW_MIN", F.col(name) < low))
        return self

    def at_most(self, name: str, high) -> Schema:
        self.rules.append((name, "ABOVE_MAX", F.col(name) > high))
        return self

    def one_of(self, name: str, values: list[str]) -> Schema:
        self.rules.append((name, "NOT_ALLOWED", ~F.col(name).isin(*values)))
        return self

    def typed(self, name: str, kind: str) -> Schema:
        """A text that does not read as kind (int, float or bool) breaks the rule; a missing one does not."""
        spark_type = {"int": "bigint", "float": "double", "bool": "boolean"}[kind]
        self.rules.append((name, "TYPE_MISMATCH", F.col(name).isNotNull() & F.col(name).try_cast(spark_type).isNull()))
        return self

    def violations(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, rule, kind), a row for each violation; no shuffle."""
        found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"))) for n, k, broken in self.rules]
        bad = F.filter(F.array(*found), lambda x: x.isNotNull())
        return rows.select(*keys, F.explode(bad).alias("_v")).select(*keys, "_v.rule", "_v.kind")
