"""Stateful operators: one fold, used over a whole table in batch and over micro-batches in streaming.

A fold (see tessera.wire.folds) takes a stream's rows in order. In batch, applyInPandas gives it all rows of a key; in streaming
its state is kept between micro-batches, as typed columns. Rows are put in order within a micro-batch; from one to the
next the source has to keep it (later rows in later micro-batches), as a fold cannot take back what it has passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _rows(frame, order):
    frame = frame.sort_values(order, kind="stable")
    names = list(frame.columns)
    return (dict(zip(names, r, strict=True)) for r in zip(*[frame[c].tolist() for c in names], strict=True))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _flushed(fold):
    return getattr(fold, "flush", tuple)()


def fold_batch(rows: DataFrame, keys: list[str], order: str, make, key_schema: str) -> DataFrame:
    """(keys, the fold's columns) for everything the fold of each key yields; what a fold holds back is flushed at the end of its key."""
    names = [*_names(key_schema), *_names(make().SCHEMA)]

    def run(key, frame):
        import pandas as pd

        fold = make()
        out = [(*key, *o) for r in _rows(frame, order) for o in fold.step(r)]
        out += [(*key, *o) for o in _flushed(fold)]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandas(run, f"{key_schema}, {make().SCHEMA}")


def fold_stream(rows: DataFrame, keys: list[str], order: str, make, key_schema: str, last: bool = False, idle_ms: int | None = None) -> DataFrame:
    """As fold_batch, for a streaming DataFrame.

    last passes on only the last row of a key in each micro-batch (running totals need no more). A key without rows for
    idle_ms is flushed and forgotten; without idle_ms a stream has no end, and keys are kept for good.
    """
    names = [*_names(key_schema), *_names(make().SCHEMA)]

    def run(key, frames, state):
        import pandas as pd

        fold = make()
        if state.exists:
            fold.restore(tuple(state.get))
        if state.hasTimedOut:
            out = [(*key, *o) for o in _flushed(fold)]
            state.remove()
        else:
            out = [(*key, *o) for r in _rows(pd.concat(list(frames)), order) for o in fold.step(r)]
            out = out[-1:] if last else out
            state.update(fold.state())
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{key_schema}, {make().SCHEMA}", make().STATE, "append", timeout)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming query over what is there now, into Parquet under folder, and reads that; for append-mode queries."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")
