"""``spark.read.format("bpk" | "mdb" | "cfg" | "sframe")`` after ``register(spark)``: a partition for each file.

Options: view (see tessera.sources.formats), strict, mode. Files are opened through pyarrow's file
systems, so a plain path, file:// and the stores pyarrow knows work; for others use formats.read, which reads by Spark.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.wire.cursor import WireError

from .formats import FORMATS


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, fmt: str, options: dict, width: int):
        self.fmt, self.options, self.width = fmt, dict(options), width

    def _store(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def partitions(self):
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(path)]
        return [_File(f.path) for f in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition):
        decoder, views = FORMATS[self.fmt]
        view = self.options.get("view", next(iter(views)))
        with self._store()[0].open_input_file(partition.path) as f:
            data = f.read()
        try:
            rows = list(decoder(data, view, {"strict": self.options.get("strict", "false").lower() == "true"}))
        except WireError as e:
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                raise
            yield (partition.path, *[None] * self.width, (e.code, e.offset, str(e)))
            return
        for r in rows:
            yield (partition.path, *r, None)


def _source(fmt: str):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return fmt

        def _view(self):
            views = FORMATS[fmt][1]
            return views[self.options.get("view", next(iter(views)))]

        def schema(self):
            return f"path string, {self._view()}, error struct<code:string,offset:bigint,message:string>"

        def reader(self, schema):
            return _Reader(fmt, self.options, len(schema.fields) - 2)

    return Source


def register(spark) -> None:
    for fmt in FORMATS:
        spark.dataSource.register(_source(fmt))
