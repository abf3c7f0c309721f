"""The four formats as DataFrames: binary files in, one table for each view out.

Files are read by Spark's binaryFile source (so from any store Spark knows, pruned by path and date),
and decoded in Arrow batches; parallelism is by file. Every view has ``path`` first and ``error`` last: a file
that cannot be decoded gives one row with a filled error struct and no partial rows, or fails the query
with ``mode="FAILFAST"``. Choose the lightest view: ``sections`` decodes no text, ``records`` all nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import journal as journals
from tessera.wire import bpk, cfg, folds, frames, mdb
from tessera.wire.cursor import WireError

_ERROR = "error struct<code:string,offset:bigint,message:string>"
_FIELDS = "array<struct<type:string,b:boolean,i64:bigint,u64:decimal(20,0),f64:double,str:binary,ref_id:decimal(20,0),blob:binary>>"


def _decimal(v):
    from decimal import Decimal

    return None if v is None else Decimal(v)


def _pick(row, names):
    return tuple(row[n] for n in names)


_CONTAINER = ("version", "flags", "checksum_ok", "header_ok", "trailer_ok", "sections", "summary")
_SECTION = ("section_idx", "type", "type_code", "id", "flags", "offset", "length", "item_count", "crc", "crc_ok", "records")
_HEAD = ("version", "page_size", "page_count", "root_page", "string_table_page", "journal_offset", "flags", "checksum_ok")
_PAGE = ("page", "type", "type_code", "flags", "slot_count", "free_start", "overflow_next", "truncated")
_FRAME = ("frame_idx", "header_offset", "type", "flags", "stream_id", "msg_id", "seq", "frag_offset", "has_crc", "crc_ok", "payload", "ref_msg_id", "window")


def _bpk(data, view, o):
    c = bpk.decode(data, o.get("strict", False), o.get("max_depth", 32))
    if view == "containers":
        yield c.version, c.flags, c.checksum_ok, c.header_ok, c.trailer_ok, len(c.sections), bpk.summarize(c)
    elif view == "sections":
        yield from (_pick(s, _SECTION) for s in c.sections)
    elif view == "records":
        yield from ((n.section, n.node, n.parent, n.ordinal, n.depth, k, n.tag, n.group, n.i64, _decimal(n.u64), n.f64, n.str, n.blob, n.key) for k, n in enumerate(c.nodes))
    elif view == "metadata":
        yield from ((k, key, n.node, n.tag, n.i64, _decimal(n.u64), n.str) for k, (key, n) in enumerate(c.metadata))
    else:
        yield from ((k, *i) for k, i in enumerate(bpk.validate(c, o.get("max_depth", 32), o.get("max_blob", 1 << 20), o.get("check_item_count", True))))


def _mdb(data, view, o):
    head = mdb.header(data, o.get("strict", False))
    if view == "databases":
        yield _pick(head, _HEAD)
        return
    pages = mdb.pages(data, head)
    if view == "summaries":
        yield mdb.summarize(data, head, pages), mdb.catalog_text(data, head, pages)
        return
    if view == "pages":
        yield from (_pick(p, _PAGE) for p in pages)
    elif view == "slots":
        yield from ((p["page"], k, *s) for p in pages for k, s in enumerate(p["slots"]))
    elif view == "strings":
        yield from enumerate(mdb.strings(data, head, pages))
    elif view == "index":
        for p in pages:
            entries, short = mdb.index(p)
            yield from ((p["page"], k, *e, short) for k, e in enumerate(entries))
    elif view == "overflow":
        for start in o.get("starts") or [p["page"] for p in pages if p["type"] == "OVERFLOW"]:
            yield start, *mdb.overflow(pages, start, o.get("max_pages", mdb.MAX_CHAIN_PAGES), o.get("max_bytes", mdb.MAX_CHAIN_BYTES))
    else:
        yield from ((-1, "SEED", *s) for s in mdb.seeds(pages))
        yield from mdb.journal(data, head)


def _cfg(data, view, o):
    doc = cfg.parse(data)
    if view == "flat":
        yield from ((k, *e) for k, e in enumerate(cfg.flatten(doc)))
    elif view == "documents":
        yield len(doc), cfg.serialize(doc, o.get("indent", 2), o.get("inline", 4)), cfg.summarize(doc)
    elif view == "tokens":
        yield from ((k, at, kind, cfg.token_name(kind, value), cfg.token_text(value)) for k, (kind, value, at) in enumerate(cfg.tokens(data)))
    elif view == "violations":
        yield from ((k, *v) for k, v in enumerate(cfg.check(doc, o["rules"])))
    elif view == "query":
        for p in o["paths"]:
            v = cfg.query(doc, p)
            miss = v is cfg.MISSING
            kind = None if miss else cfg.type_name(v)
            yield p, kind, *[cfg.convert(v, k) for k in ("int", "float", "bool", "string")], None if miss else cfg.serialize_value(v)
    else:
        ids = iter(range(1 << 62))

        def nodes(stmts, parent):
            for k, s in enumerate(stmts):
                me = next(ids)
                text = cfg.serialize_value(s.value) if s.kind == "assignment" else s.target.decode("utf-8", "replace") if s.kind == "include" else None
                yield me, parent, k, s.kind, s.name or None, s.label, s.path or None, cfg.type_name(s.value) if s.kind == "assignment" else None, text
                yield from nodes(s.children, me)

        yield from nodes(doc, None)


def _frames(data, view, o):
    decoded = frames.decode(data, o.get("trailing", "error"))
    if view == "summaries":
        yield (summarize_frames(decoded),)
    else:
        yield from (_pick(f, _FRAME) for f in decoded)


def summarize_frames(decoded) -> str:
    """A decoded stream as an indented text: counters, messages, streams, controls, acknowledgements."""
    flow = list(decoded)
    parts, stats, messages = {}, {}, []
    for f in flow:
        stream = f["stream_id"]
        messages += [(stream, *m) for m in parts.setdefault(stream, folds.ReassemblyFold()).step(f)]
        for row in stats.setdefault(stream, [folds.SequenceFold(), None])[0].step({"seq": f["seq"], "is_reset": f["type"] == "RESET"}):
            stats[stream][1] = row
    of = lambda kind: [f for f in flow if f["type"] == kind]
    counts = (("frames seen", len(flow)), ("messages emitted", len(messages)), ("control frames", len(of("CONTROL"))), ("ack frames", len(of("ACK"))), ("reset frames", len(of("RESET"))), ("header crc ok", sum(f["crc_ok"] is True for f in flow)), ("header crc bad", sum(f["crc_ok"] is False for f in flow)))
    lines = ["streamcodec decode", *[f"  {name:<16} : {n}" for name, n in counts], "messages:"]
    for stream, msg, compressed, data, _ in messages:
        some = " ".join(f"0x{b:02x}" for b in data[:16]) + (" ..." if len(data) > 16 else "")
        lines += [f"  stream {stream} msg {msg} size {len(data)}{' [compressed]' if compressed else ''}", f"    bytes: {some}"]
    lines.append("streams:")
    lines += [f"  id {stream} frames={n} gaps={gaps} dups={dups} resets={resets}" for stream, (_, (_, n, gaps, dups, resets)) in sorted(stats.items())]
    if of("CONTROL"):
        lines += ["controls:", *[f"  stream {f['stream_id']} ref_msg={f['ref_msg_id']} window={f['window']}" for f in of("CONTROL")]]
    if of("ACK"):
        lines += ["acks:", *[f"  stream {f['stream_id']} msg {f['msg_id']}" for f in of("ACK")]]
    return "\n".join(lines) + "\n"


#: (decoder, {view: columns}) of each format.
FORMATS = {
    "bpk": (_bpk, {
        "containers": "version int, flags int, checksum_ok boolean, header_ok boolean, trailer_ok boolean, sections int, summary string",
        "sections": "section_idx int, type string, type_code int, id int, flags int, offset bigint, length bigint, item_count bigint, crc bigint, crc_ok boolean, records bigint",
        "records": "section_idx int, node_id bigint, parent_id bigint, ordinal int, depth int, pre_order bigint, tag string, group boolean, i64 bigint, u64 decimal(20,0), f64 double, str binary, blob binary, key binary",
        "metadata": "ordinal int, key binary, value_node_id bigint, tag string, i64 bigint, u64 decimal(20,0), str binary",
        "issues": "ordinal int, severity string, kind string, section_idx int, at string",
    }),
    "mdb": (_mdb, {
        "databases": "version int, page_size int, page_count bigint, root_page bigint, string_table_page bigint, journal_offset bigint, flags bigint, checksum_ok boolean",
        "summaries": "summary string, catalog string",
        "pages": "page bigint, type string, type_code int, flags int, slot_count int, free_start int, overflow_next int, truncated boolean",
        "slots": "page bigint, slot int, offset int, length int, in_bounds boolean",
        "strings": "id bigint, bytes binary",
        "index": "page_index bigint, ordinal int, key binary, page bigint, slot int, truncated boolean",
        "overflow": "start bigint, status string, bytes binary, visited array<bigint>",
        "journal": "op_idx bigint, op string, page bigint, slot int, bytes binary",
    }),
    "cfg": (_cfg, {
        "flat": "ordinal int, key string, value string",
        "documents": "nodes int, canonical string, summary string",
        "tokens": "ordinal int, offset bigint, kind string, name string, text string",
        "violations": "ordinal int, kind string, rule string",
        "query": "query string, type string, as_int bigint, as_float double, as_bool boolean, as_string binary, text string",
        "nodes": "node_id bigint, parent_id bigint, ordinal int, kind string, name string, label binary, assign_path array<string>, value_type string, value string",
    }),
    "sframe": (_frames, {
        "frames": "frame_idx bigint, header_offset bigint, type string, flags int, stream_id int, msg_id bigint, seq int, frag_offset bigint, has_crc boolean, crc_ok boolean, payload binary, ref_msg_id bigint, window bigint",
        "summaries": "summary string",
    }),
}


def decode(files: DataFrame, fmt: str, view: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """A view of files (path, content), as binaryFile gives them."""
    run, views = options.pop("formats", FORMATS)[fmt]
    schema = f"path string, {views[view]}, {_ERROR}"
    width = len(files.sparkSession.createDataFrame([], schema).columns) - 2
    arrow = _arrow_schema(files.sparkSession, schema)

    def batches(source):
        import pyarrow as pa

        for b in source:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in run(content or b"", view, options)]
                except WireError as e:
                    if mode == "FAILFAST":
                        raise
                    rows = [(path, *[None] * width, {"code": e.code, "offset": e.offset, "message": str(e)})]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(batches, schema)


def _arrow_schema(spark: SparkSession, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def read(spark: SparkSession, path: str, fmt: str, view: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """A view of all files under path (globs allowed)."""
    return decode(spark.read.format("binaryFile").load(path), fmt, view, mode, **options)


def read_stream(spark: SparkSession, path: str, fmt: str, view: str, mode: str = "PERMISSIVE", files_per_trigger: int = 100, **options) -> DataFrame:
    """A view as a streaming DataFrame: files that appear under path, each decoded once."""
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return decode(source.schema(schema).load(path), fmt, view, mode, **options)


def visit(files: DataFrame, make_visitor, schema: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """(path, schema's columns, error): what a visitor of each container yields.

    make_visitor() gives an object with any of the hooks of tessera.wire.bpk.Visitor; each may yield tuples of schema's columns.
    """

    def run(data, view, o):
        return bpk.walk(bpk.decode(data, o.get("strict", False), o.get("max_depth", 32)), make_visitor())

    return decode(files, "bpk", "visit", mode, formats={"bpk": (run, {"visit": schema})}, **options)


def _fields_of(live: DataFrame, mode: str) -> DataFrame:
    """(path, page, slot, fields, error) of records (path, page, slot, bytes); error where a record cannot be taken apart, unless that fails the query."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, errors = [], []
            for record in b.column(3).to_pylist():
                try:
                    rows.append([f | {"u64": _decimal(f["u64"]), "ref_id": _decimal(f["ref_id"])} for f in mdb.fields(record)])
                    errors.append(None)
                except WireError as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append(None)
                    errors.append({"code": e.code, "offset": e.offset, "message": str(e)})
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, arrow.field("fields").type), pa.array(errors, arrow.field("error").type)], schema=arrow)

    schema = f"path string, page bigint, slot int, fields {_FIELDS}, {_ERROR}"
    arrow = _arrow_schema(live.sparkSession, schema)
    return live.select("path", "page", "slot", "bytes").mapInArrow(run, schema)


def mdb_records(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Live records after journal replay: (path, page, slot, fields with str resolved and ref_resolved, error).

    Decoded operations go through the journal plans: outcome by windows, last committed wins by one
    aggregation. Only survivors are taken apart, and string references are a left join on (path, id). A file that
    cannot be opened, or with a record that cannot be taken apart, is one row with an error and nothing else.
    """
    decoded = decode(files, "mdb", "journal", mode)
    ops = decoded.where("error is null").drop("error")
    marked = journals.outcomes(ops.where("op <> 'SEED'"), ["path"], "op_idx").where(F.col("outcome").isin("AUTO", "COMMITTED")).drop("outcome")
    live = journals.replay(ops.where("op = 'SEED'").unionByName(marked), ["path", "page", "slot"], "op_idx", F.col("op") == "DELETE", ["bytes"])
    taken = _fields_of(live, mode)
    bad = taken.where("error is not null").groupBy("path").agg(F.min_by("error", F.struct("page", "slot")).alias("error"))
    records = taken.where("error is null").drop("error").join(bad, "path", "left_anti")
    names = decode(files, "mdb", "strings", mode).where("error is null").select("path", F.col("id").cast("decimal(20,0)").alias("ref_id"), F.col("bytes").alias("text"))
    long = records.select("path", "page", "slot", F.posexplode_outer("fields").alias("i", "f")).withColumn("ref_id", F.col("f.ref_id"))
    long = long.join(names, ["path", "ref_id"], "left")
    one = F.struct("i", F.col("f").withField("str", F.coalesce("f.str", "text")).withField("ref_resolved", F.when(F.col("f.type") == "STRING_REF", F.col("text").isNotNull())).alias("f"))
    packed = long.groupBy("path", "page", "slot").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), one))).alias("fs"))
    out = packed.select("path", "page", "slot", F.transform("fs", lambda x: x["f"]).alias("fields"), F.lit(None).cast(_ERROR.removeprefix("error ")).alias("error"))
    if mode == "FAILFAST":
        return out
    failed = decoded.where("error is not null").select("path", "error").unionByName(bad)
    return out.unionByName(failed, allowMissingColumns=True)


def mdb_counts(files: DataFrame) -> DataFrame:
    """(path, committed_ops, rolled_back_ops): operations that took effect, and those a rollback or the end of the journal undid."""
    ops = decode(files, "mdb", "journal").where("error is null and op <> 'SEED'")
    o = journals.outcomes(ops, ["path"], "op_idx")
    return o.groupBy("path").agg(F.count_if(F.col("outcome").isin("AUTO", "COMMITTED")).alias("committed_ops"), F.count_if(F.col("outcome") == "ROLLED_BACK").alias("rolled_back_ops"))


def mdb_catalog(files: DataFrame) -> DataFrame:
    """(path, type, n): pages of each known type, zeros included."""
    pages = decode(files, "mdb", "pages").where("error is null")
    kinds = F.explode(F.array(*[F.lit(k) for k in mdb.PAGES]))
    every = pages.select("path").distinct().select("path", kinds.alias("type"))
    return every.join(pages.groupBy("path", "type").agg(F.count("*").alias("n")), ["path", "type"], "left").select("path", "type", F.coalesce("n", F.lit(0)).alias("n"))


def mdb_slot_use(files: DataFrame) -> DataFrame:
    """(path, page, used, dead): slots that hold a record and slots that do not."""
    used = F.col("in_bounds") & (F.col("length") > 0)
    return decode(files, "mdb", "slots").where("error is null").groupBy("path", "page").agg(F.count_if(used).alias("used"), F.count_if(~used).alias("dead"))


def mdb_totals(files: DataFrame) -> DataFrame:
    """(path, pages, live_records, used_slots, dead_slots, strings, string_bytes): a store's catalog in one row."""
    pages = decode(files, "mdb", "pages").where("error is null").groupBy("path").agg(F.count("*").alias("pages"))
    live = mdb_records(files).where("error is null").groupBy("path").agg(F.count("*").alias("live_records"))
    slots = mdb_slot_use(files).groupBy("path").agg(F.sum("used").alias("used_slots"), F.sum("dead").alias("dead_slots"))
    texts = decode(files, "mdb", "strings").where("error is null").groupBy("path").agg(F.count("*").alias("strings"), F.sum(F.octet_length("bytes")).cast("long").alias("string_bytes"))
    out = pages
    for part in (live, slots, texts):
        out = out.join(part, "path", "left")
    return out.na.fill(0)
