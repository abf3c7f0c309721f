"""The registry of driver queries: each function beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(rows: DataFrame, build) -> DataFrame:
    """(path, content) from rows (path, items): build makes a file's bytes of its items, a list of dicts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [build(path, items) for path, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.select("path", "items").mapInArrow(run, "path string, content binary")
