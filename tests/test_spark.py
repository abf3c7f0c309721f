"""Sources, plans and streaming on Spark; driver queries against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.wire import bpk, frames, mdb

from .test_wire import NESTED, SAMPLE, store

SF = "/root/testdata/sf0.001"


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


def test_bpk_views(spark):
    from tessera.sources.formats import decode
    from tessera.sources.sinks import bpk_containers

    data = bpk.encode([*NESTED, {"type": "METADATA", "records": [("KEYVAL", (b"k", ("UINT", 2**64 - 1)))]}])
    src = files(spark, a=data, b=b"XXXX0000")
    nodes, sections = (decode(src, "bpk", v) for v in ("records", "sections"))
    assert [r.tag for r in nodes.where("path = 'a'").orderBy("pre_order").collect()][:3] == ["GROUP", "ARRAY", "UINT"]
    assert decode(src, "bpk", "containers").where("error is not null").first().error.code == "BadMagic"
    assert decode(src, "bpk", "metadata").where("path = 'a'").first().u64 == 2**64 - 1
    ok = "error is null"
    (back,) = bpk_containers(nodes.where(ok), sections.where(ok)).collect()
    assert bytes(back.content) == data
    with pytest.raises(Exception, match="magic"):
        decode(src, "bpk", "sections", mode="FAILFAST").collect()


def test_mdb_replay(spark, tmp_path):
    from tessera.sources.formats import mdb_catalog, mdb_counts, mdb_records, mdb_slot_use, read

    rec = lambda *f: mdb.encode_record(list(f))
    ops = [("BEGIN",), ("INSERT", 1, 0, rec(("STRING_REF", 1), ("INT", -7), ("STRING_REF", 9))), ("COMMIT",), ("DELETE", 0, 1), ("BEGIN",), ("UPDATE", 0, 0, rec(("UINT", 222))), ("ROLLBACK",), ("BEGIN",), ("DELETE", 0, 0)]
    (tmp_path / "x.mdb").write_bytes(store(ops, [[("UINT", 111)], [("NULL", None)]]))
    src = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {(r.page, r.slot): r.fields for r in mdb_records(src).collect()}
    assert set(rows) == {(0, 0), (1, 0)} and rows[0, 0][0].u64 == 111
    ref, number, dangling = rows[1, 0]
    assert (bytes(ref.str), ref.ref_resolved, number.i64, dangling.ref_resolved, dangling.str) == (b"world", True, -7, False, None)
    assert mdb_counts(src).first()[1:] == (2, 2)
    assert {r.type: r.n for r in mdb_catalog(src).collect()} == {"FREE": 0, "DATA": 1, "STRINGS": 1, "INDEX": 0, "OVERFLOW": 0}
    assert mdb_slot_use(src).first()[1:] == (0, 2, 0)
    assert read(spark, str(tmp_path), "mdb", "strings").count() == 2


def test_cfg_views(spark):
    from tessera.operators.config import diff
    from tessera.sources.formats import decode
    from tessera.wire.cfg import Rule

    src = files(spark, a=SAMPLE, b=SAMPLE.replace(b"retries = 3", b"attempts = 4"), c=b"a = 1/0;")
    flat = decode(src, "cfg", "flat")
    assert flat.where("path = 'c'").first().error.code == "StateViolation"
    side = lambda p: flat.where(F.col("path") == p).select("key", "value")
    assert side("c").first().key is None and decode(files(spark, a=b"x = 1e300; y = 1.5;"), "cfg", "query", paths=["x", "y"]).select("as_int").collect() == [(None,), (1,)]
    src2 = files(spark, a=b"x = 1; y = 2; z = 3;", b=b"x = 1; y = 5; w = 4;")
    flat = decode(src2, "cfg", "flat")
    assert {(r.key, r.kind) for r in diff(side("a"), side("b"), "key", "value").collect()} == {("y", "CHANGED"), ("z", "REMOVED"), ("w", "ADDED")}
    assert decode(src2, "cfg", "query", paths=["y", "nope"]).where("path = 'b'").select("as_int").collect() == [(5,), (None,)]
    assert decode(src2, "cfg", "violations", rules=[Rule("z", "int", required=True)]).where("kind is not null").count() == 1
    assert decode(src, "cfg", "nodes").where("path = 'a' and kind = 'block'").count() == 2


def test_frames_batch_and_stream(spark, tmp_path):
    from tessera.sources.formats import decode
    from tessera.sources.sinks import message_frames
    from tessera.streaming.folds import drain, fold_batch, fold_stream
    from tessera.wire.folds import ReassemblyFold

    msgs = [(1, 5, bytes(range(200)) * 3, 65535, True), (2, 6, b"", 0, False)]
    for crc in (False, True):
        made = message_frames(spark.createDataFrame(msgs, "stream_id int, msg_id long, data binary, first_seq int, compressed boolean"), 250, crc).orderBy("stream_id", "frag_idx").collect()
        want = [f for s, m, d, q, c in msgs for f in frames.encode_message(s, m, d, 250, q, c, crc)]
        assert [bytes(r.content) for r in made] == want
    got = decode(files(spark, a=b"".join(want)), "sframe", "frames")
    keys = (["path", "stream_id"], "frame_idx", ReassemblyFold, "path string, stream_id int")
    batch = {(r.stream_id, r.msg_id, bytes(r.data)) for r in fold_batch(got, *keys).collect()}
    assert batch == {(1, 5, msgs[0][2]), (2, 6, b"")}
    for k in range(2):
        got.where(F.pmod("frame_idx", F.lit(2)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(got.schema).parquet(str(tmp_path / "in"))
    assert {(r.stream_id, r.msg_id) for r in drain(fold_stream(live, *keys), str(tmp_path / "out")).collect()} == {(1, 5), (2, 6)}


def test_functions(spark):
    from tessera.functions import registry as r
    from tessera.wire import digests

    r.register(spark)
    row = spark.sql("select adler32(b) a, crc16(b) c, fnv1a_32(b) f, bytes_escape(b) e, rle_decompress(rle_compress(b)).data d from (select cast('Wikipedia' as binary) b)").first()
    assert (row.a, row.c, row.f, row.e, bytes(row.d)) == (0x11E60398, digests.crc16(b"Wikipedia"), digests.fnv1a(b"Wikipedia", 32), "Wikipedia", b"Wikipedia")
    one = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04"), 171, "aé")], "b binary, n int, s string").select(r.big_endian(F.col("b"), 0, 2).alias("be"), r.little_endian(F.col("b"), 1, 2).alias("le"), r.to_hex(F.col("n"), 4).alias("h"), r.codepoints(F.col("s")).alias("c")).first()
    assert (int(one.be), int(one.le), one.h, one.c) == (0x0102, 0x0302, "0x00ab", [97, 233])


def canonical(df):
    def cell(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if isinstance(x, float):
            return int(x) if x == int(x) else round(x, 6)
        return x if isinstance(x, (int, bool, str)) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


def core():
    from tessera.plans.queries import ORACLE

    return sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", core())
def test_query_matches_sql(spark, duck, name):
    from tessera.plans.queries import ORACLE, QUERIES

    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_tree_queries_and_datasource(spark, tmp_path):
    from tessera.operators import tree
    from tessera.sources.datasource import register
    from tessera.sources.formats import decode, mdb_records

    data = bpk.encode([{"type": "DATA", "id": 3, "records": [("UINT", 1), ("GROUP", [("UINT", 2), ("UINT", 3), ("STRING", b"s")])]}, {"type": "DATA", "id": 3, "item_count": 9}, {"type": "METADATA", "records": [("KEYVAL", (b"k", ("UINT", 7))), ("KEYVAL", (b"k", ("INT", 8)))]}])
    (tmp_path / "a.bpk").write_bytes(data)
    register(spark)
    read = lambda view: spark.read.format("bpk").option("view", view).load(str(tmp_path))
    nodes, sections = read("records"), read("sections")
    assert [r.u64 for r in tree.collect_records(nodes, "UINT", section=0).collect()] == [1, 2, 3]
    assert tree.collect_records(nodes, "UINT", recursive=False).count() == 1
    assert tree.find_section(sections, ident=3).first().section_idx == 0 and tree.find_sections(sections, "DATA").count() == 2
    value = tree.metadata_value(read("metadata"), b"k")
    assert value.select(tree.typed("UINT"), tree.typed("INT")).collect() == [(7, None)]
    assert tree.tree_stats(nodes).first()[1:] == (1, 0, 2, 6, 1) and tree.item_count_mismatches(sections).count() == 1
    fields = [("NULL", None), ("BOOL", True), ("INT", -7), ("STRING_REF", 1), ("STRING_REF", 9), ("INLINE_STRING", b"x"), ("BLOB", b"ab")]
    rows = tree.project_row(mdb_records(files(spark, a=store(records=[fields[:3]], journal=[("INSERT", 0, 1, mdb.encode_record(fields))])))).orderBy("slot").collect()
    assert rows[1]["values"] == ["null", "true", "-7", "world", "#9", "x", "blob[2]"]
    assert decode(files(spark, a=data), "bpk", "records").count() == nodes.count()


def test_hex_of_whole_texts(spark):
    from tessera.plans.queries import QUERIES

    got = {r.doc_id: r.text_hex for r in QUERIES["hex_text"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert got == {i: None if t is None else t.encode().hex() for i, t in texts.items()} and max(map(len, filter(None, got.values()))) > 1000


def test_fold_batch_releases_what_waits_behind_a_hole(spark):
    from tessera.streaming.folds import fold_batch
    from tessera.wire.folds import DeliveryFold

    rows = spark.createDataFrame([(1, n, m) for n, m in enumerate([0, 3, 2, 2, 7, 6])] + [(2, 0, 5)], "user_id long, arrival long, msg_id long")
    got = fold_batch(rows, ["user_id"], "arrival", DeliveryFold, "user_id long").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0), (1, 2, 1, 1), (1, 3, 1, 1), (1, 6, 2, 1), (1, 7, 2, 1), (2, 5, 0, 0)]


def test_mdb_records_of_a_damaged_file(spark):
    """A record that cannot be taken apart is an error of its file and of no other."""
    from tessera.sources.formats import mdb_records

    good = store([("INSERT", 1, 0, mdb.encode_record([("INT", 1)]))], [])
    bad = store([("INSERT", 1, 0, b"\x01\x63"), ("INSERT", 1, 1, mdb.encode_record([("INT", 1)]))], [])
    rows = {r.path: r for r in mdb_records(files(spark, good=good, bad=bad, junk=b"MDB9")).collect()}
    assert len(rows) == 3 and rows["good"].fields[0].i64 == 1 and rows["good"].error is None
    assert (rows["bad"].fields, rows["bad"].error.code, rows["junk"].error.code) == (None, "BadType", "ShortRead")
    with pytest.raises(Exception, match="field type"):
        mdb_records(files(spark, bad=bad), mode="FAILFAST").collect()


def test_frames_of_a_stream_of_files(spark, tmp_path):
    """Binary files that arrive one after another, read as a stream and put together with state."""
    from tessera.sources.formats import read_stream
    from tessera.streaming.folds import drain, fold_stream
    from tessera.wire.folds import ReassemblyFold

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.sframe").write_bytes(b"".join(frames.encode_message(1, k, f"message {k}".encode() * 5, 7)))
    live = read_stream(spark, str(tmp_path / "in"), "sframe", "frames", files_per_trigger=1)
    done = drain(fold_stream(live, ["path", "stream_id"], "frame_idx", ReassemblyFold, "path string, stream_id int"), str(tmp_path / "out"))
    assert {(r.msg_id, bytes(r.data).decode()) for r in done.collect()} == {(k, f"message {k}" * 5) for k in range(3)}


@pytest.mark.parametrize("make", ["SequenceFold", "ReassemblyFold", "DeliveryFold", "DeliveryTotals", "FlowFold", "JournalFold"])
def test_folds_go_on_from_their_state(make):
    """A fold that is stopped and restored after each row gives what one without a stop does."""
    from tessera.wire import folds

    make = getattr(folds, make)
    rows = [{"seq": k * k % 7, "is_reset": k == 5, "frame_idx": k, "type": "DATA", "flags": 2 | (k % 3 == 2), "msg_id": k * 5 % 11, "frag_offset": k % 3 * 4, "payload": b"abcd", "kind": ("WINDOW", "SEND", "ACK")[k % 3], "amount": k * 10, "point": k, "op": ("BEGIN", "INSERT", "DELETE", "COMMIT")[k % 4], "page": k, "slot": 0, "bytes": b"x"} for k in range(40)]
    plain, stopped = make(), make()
    for r in rows:
        again = make()
        again.restore(stopped.state())
        assert list(plain.step(r) or ()) == list(again.step(r) or ())
        stopped = again
    assert list(getattr(plain, "flush", tuple)()) == list(getattr(stopped, "flush", tuple)())


def test_idle_streams_are_flushed(spark, tmp_path):
    """Messages behind a hole are released when nothing has come for a while, and the key is forgotten."""
    import time

    from tessera.streaming.folds import fold_stream
    from tessera.wire.folds import DeliveryFold

    rows = spark.createDataFrame([(1, n, m) for n, m in enumerate([0, 3, 2])], "user_id long, arrival long, msg_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    folded = fold_stream(live, ["user_id"], "arrival", DeliveryFold, "user_id long", idle_ms=1000)
    query = folded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = sorted(tuple(r) for r in spark.read.schema(folded.schema).parquet(str(tmp_path / "out")).collect()) if os.path.exists(tmp_path / "out" / "_spark_metadata") else []
            if len(got) == 3:
                break
        assert got == [(1, 0, 0, 0), (1, 2, 1, 0), (1, 3, 1, 0)]
    finally:
        query.stop()


def test_command(tmp_path, capsys, monkeypatch):
    """Exit codes and output of the command for files, standard input, damaged files and wrong calls."""
    import io

    from tessera.__main__ import main

    path = tmp_path / "a"
    for fmt, data, head in (("bpk", bpk.encode(NESTED), "BPK1 container"), ("mdb", store([], []), "minidb MDB1 store"), ("cfg", b"a = 1;", "cfgscript document: 1"), ("sframe", frames.encode_frame(), "streamcodec decode")):
        path.write_bytes(data)
        assert main([fmt, str(path)]) == 0 and capsys.readouterr().out.startswith(head)
        path.write_bytes(b"\0junk")
        assert main([fmt, str(path)]) == 1 and capsys.readouterr().err.startswith("error")
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"b = 2;")))
    assert main(["cfg", "-"]) == 0 and "b = 2" in capsys.readouterr().out
    assert main(["cfg", str(tmp_path / "none")]) == 1 and main(["zip", "x"]) == 2 and main([]) == 2


def test_expressions_refuse(spark):
    from tessera.functions import expr

    n = lambda k: F.lit(k).cast("long")
    for bad in (expr.divide(n(1), n(0)), expr.remainder(n(1), n(0)), expr.shift_left(n(1), n(64)), expr.shift_right(n(1), n(-1)), expr.divide_float(F.lit(1.0), F.lit(0.0))):
        with pytest.raises(Exception, match="StateViolation"):
            spark.range(1).select(bad).collect()
    lazy = expr.choose(F.col("id") == 0, n(7), expr.divide(n(1), F.col("id")))
    assert [r[0] for r in spark.range(2).select(lazy).collect()] == [7, 1]


def test_hashes_of_many_values_at_once():
    import random

    from tessera.wire import digests as d

    rnd = random.Random(4)
    values = [rnd.randbytes(rnd.choice([0, 1, 5, 200, 3000])) for _ in range(100)]
    for bits in (32, 64):
        assert d.fnv1a_all(values, bits).tolist() == [d.fnv1a(v, bits) for v in values] and d.fnv1a_all([], bits).tolist() == []
    assert d.mix64(0) == 0xE220A8397B1DCDAF  # the first number of splitmix64 from 0
    assert d.hash_combine(1, 2) != d.hash_combine(2, 1) and 0 <= d.hash_combine(2**64 - 1, 2**64 - 1) < 2**64


def test_wrong_checksums_are_wrong_for_every_header(spark, tmp_path):
    """Headers of each kind of which the right checksum is b"??", bytes that must not pass for a wrong one; beside them frames with a right one and with none."""
    from tessera.plans.queries import ORACLE, QUERIES

    hit = [(688408, 30, "view"), (2353056, 12, "signup"), (5265704, 8, "click"), (2095168, 4, "error")]
    for (k, user, _), kind, flags in zip(hit, ("DATA", "CONTROL", "ACK", "RESET"), (frames.FIN, 0, 0, 0), strict=True):
        size = {"DATA": k % 5, "CONTROL": 8}.get(kind, 0)
        assert frames.encode_frame(kind, user, k, k // 64 % 65536, bytes(size), flags, with_crc=True)[19:21] == b"??"
    rows = [(k + d, user, event) for k, user, event in hit for d in (0, 1, 4)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["sframe_counters"](spark, str(tmp_path))
    with duckdb.connect() as con:
        want = con.sql(ORACLE["sframe_counters"].replace("from events", f"from read_parquet('{tmp_path}/events.parquet/*.parquet')"))
        assert got.columns == want.columns and sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
    assert {tuple(r)[-2:] for r in got.collect()} == {(1, 1)}
