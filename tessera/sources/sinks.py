"""Encoders: rows to the formats' bytes, as binary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequences import MODULUS
from tessera.wire import bpk, frames


def bpk_containers(nodes: DataFrame, sections: DataFrame, flags: int = 0) -> DataFrame:
    """(path, content) from the node and section tables that reading gives; one container a path."""
    tables = nodes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pre_order", "section_idx", "node_id", "parent_id", "tag", "group", "i64", "u64", "f64", "str", "blob", "key"))).alias("nodes"))
    heads = sections.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("section_idx", "type", "id", "flags", "item_count"))).alias("sections"))

    def build(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for s, n in zip(b.column("sections").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                out.append(bpk.encode(_assemble(s, n or []), flags))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return heads.join(tables, "path", "left").select("path", "sections", "nodes").mapInArrow(build, "path string, content binary")


def _assemble(sections: list[dict], nodes: list[dict]) -> list[dict]:
    children: dict = {}
    for n in nodes:
        children.setdefault((n["section_idx"], n["parent_id"]), []).append(n)

    def spec(n):
        tag, below = n["tag"], children.get((n["section_idx"], n["node_id"]), [])
        if tag in ("ARRAY", "GROUP"):
            value = [spec(c) for c in below]
        elif tag == "KEYVAL":
            value = (bytes(n["key"]), spec(below[0]))
        else:
            value = {"INT": n["i64"], "UINT": n["u64"], "FLOAT": n["f64"], "STRING": n["str"], "BLOB": n["blob"]}[tag]
            value = int(value) if tag == "UINT" else value
        return tag, value, n["group"]

    return [s | {"records": [spec(n) for n in children.get((s["section_idx"], None), [])]} for s in sections]


def message_frames(messages: DataFrame, most: int, with_crc: bool = False) -> DataFrame:
    """Messages (stream_id, msg_id, data, first_seq, compressed) to frames: their rows and ``content``, the frame's bytes.

    All but the checksum is column expressions: a message explodes to its fragments, headers are big-endian hex.
    """
    most = min(max(most, 1), frames.MOST_PAYLOAD)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / most)).cast("int")
    parts = messages.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.expr(f"substring(data, _k * {most} + 1, {most})")
    flag = lambda test, bit: F.when(test, bit).otherwise(0)
    flags = flag(F.col("compressed"), frames.COMPRESSED) + flag(F.col("_n") > 1, frames.FRAG) + flag(F.col("_k") == F.col("_n") - 1, frames.FIN) + (frames.HAS_CRC if with_crc else 0)
    out = parts.withColumn("payload", part).withColumn("flags", flags).withColumn("seq", F.pmod(F.col("first_seq") + F.col("_k"), F.lit(MODULUS))).withColumn("frag_offset", F.col("_k") * most)
    big = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * size, "0"))
    head = F.concat(F.unhex(F.lit("53C70100")), big(F.col("flags"), 1), big(F.col("stream_id"), 2), big(F.col("msg_id"), 4), big(F.col("seq"), 2), big(F.col("frag_offset"), 4), big(F.octet_length("payload"), 2))
    if with_crc:
        from tessera.functions.registry import crc16

        head = F.concat(head, big(crc16(head), 2))
    return out.withColumn("content", F.concat(head, F.col("payload"))).select("stream_id", "msg_id", F.col("_k").alias("frag_idx"), "seq", "flags", "frag_offset", "content")
