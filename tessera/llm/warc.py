"""WARC archives: writing, and normalising monolithic gzip files to one member a record with an offset index.

A crawl's files may each be one gzip stream, from which no single record can be read. The normaliser
inflates such a file once, from front to end, in pieces; every record goes to the new file as a gzip
member of its own, and a sidecar (``.cdx``: offset, length, type, page) lists where. Afterwards any
record is read by a seek. Records whose payload another page has as well become revisits on the way.

Files go to the folder all executors share. Each attempt of a task writes files of its own name, and
only those whose rows were committed are ever looked at, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, dealt_anew, drop_path, fresh_dir

#: Payloads shorter than this are never turned into revisits.
REVISIT_LEAST = 100
RAW_LEVEL, MEMBER_LEVEL = 1, 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def open_uri(uri: str, mode: str):
    """A binary file of a shared store: a mounted folder, or any file system that pyarrow knows."""
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def _record(kind: str, page, url, digest: str, n: int, payload: bytes, refers_to=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:page:unknown"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """kind, page, refers_to, digest, n (the full payload's length), url, payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    number = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"kind": fields["WARC-Type"], "page": number(fields["WARC-Record-ID"]), "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "n": n, "url": fields["WARC-Target-URI"], "payload": payload}


def inflated(f):
    """The bytes of a gzip file of one or more members, in pieces."""
    d = zlib.decompressobj(31)
    while data := f.read(_CHUNK):
        while data:
            yield d.decompress(data)
            data = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)
            else:
                break


def records(pieces):
    """The records in a stream of bytes, each whole."""
    held = bytearray()
    at = 0
    for piece in pieces:
        held += piece
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            mark = held.rfind(b"\r\nContent-Length: ", at, end)
            size = int(held[mark + 18 : end].split(b"\r\n")[0])
            stop = end + 4 + size + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        if at:
            del held[:at]
            at = 0


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes each partition as one gzip stream of response records; (file, seq, page, n, digest) of every record, cut."""

    def run(batches):
        import pyarrow as pa

        name, out, deflate, seq = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", None, None, 0
        for b in batches:
            rows = []
            for page, url, html in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if out is None:
                    out, deflate = open_uri(name, "wb"), zlib.compressobj(RAW_LEVEL, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                out.write(deflate.compress(_record("response", page, url, digest, len(payload), payload)))
                rows.append((name, seq, page, len(payload), digest))
                seq += 1
            if rows:
                names = ["file", "seq", "page", "n", "digest"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.write(deflate.flush())
            out.close()

    src = bounded_batches(pages).selectExpr(f"cast(`{id_col}` as bigint) as page", f"`{url_col}` as url", f"`{html_col}` as html")
    return cut(src.mapInArrow(run, "file string, seq bigint, page bigint, n bigint, digest string"))


def normalise(raw: DataFrame, folder: str, least: int = REVISIT_LEAST) -> DataFrame:
    """Rewrites the files of raw (as from write_monolithic) with a member for each record; (file, offset, size) of each, cut.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page id stays a
    response, the others become revisits of it. Records without a page id stay responses.
    """
    firsts = raw.where((F.col("n") >= least) & F.col("page").isNotNull()).groupBy("n", "digest").agg(F.min("page").alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts = firsts.select(dealt_anew(F.col("n")).alias("n"), "digest", "first")  # so that a payload of many pages can be split
    again = raw.join(firsts, ["n", "digest"]).where("page <> first").groupBy("file").agg(F.collect_list(F.struct("seq", "first")).alias("again"))
    files = raw.groupBy("file").agg(F.count("*").alias("records"))
    n_files = max(1, files.count())
    todo = files.join(again, "file", "left").repartition(n_files, "file")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for file, again in zip(b.column("file").to_pylist(), b.column("again").to_pylist(), strict=True):
                refers = {x["seq"]: x["first"] for x in again or ()}
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offset, rows, lines = 0, [], []
                with open_uri(file, "rb") as src, open_uri(name, "wb") as out:
                    for seq, rec in enumerate(records(inflated(src))):
                        r = parse(rec)
                        if seq in refers:
                            rec = _record("revisit", r["page"], r["url"], r["digest"], r["n"], b"", refers[seq])
                        z = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        rows.append((name, offset, len(member)))
                        lines.append(f"{offset} {len(member)} {'revisit' if seq in refers else 'response'} {r['page']}\n")
                        offset += len(member)
                with open_uri(name.removesuffix(".warc.gz") + ".cdx", "wb") as side:
                    side.write("".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "size"])

    return cut(todo.select("file", "again").mapInArrow(run, "file string, offset bigint, size bigint"))


def read_records(index: DataFrame) -> DataFrame:
    """The records at (file, offset, size): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A response's digest is that of the bytes read; if it is not the one in its header the task fails.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, name, f = [], None, None
            for file, offset, size in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, open_uri(file, "rb")
                f.seek(offset)
                r = parse(zlib.decompress(f.read(size), 31))
                if r["kind"] == "response" and (hashlib.sha256(r["payload"]).hexdigest() != r["digest"] or len(r["payload"]) != r["n"]):
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                rows.append((r["page"], r["n"], r["digest"], r["kind"], r["refers_to"], r["url"], r["payload"]))
            if f:
                f.close()
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    return index.select("file", "offset", "size").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes pages as monolithic archives, normalises them into folder and reads all records back (see read_records).

    One record for every row; null html is an empty payload, a null url is written as urn:page:unknown. A null page id
    is read back as null and such records are never revisits. Rows that repeat page id and payload
    are responses all. An empty table writes no files and gives no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    raw_dir = fresh_dir(spark, "warc-raw")
    raw = write_monolithic(pages, raw_dir, id_col, url_col, html_col)
    index = normalise(raw, folder or fresh_dir(spark, "warc"))
    drop_path(spark, raw_dir)
    return read_records(index)
