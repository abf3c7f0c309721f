"""Functions on columns: hashes, escapes, run lengths. ``register`` makes them known to SQL.

UTF-8 functions are column expressions; hashes that Spark lacks run in Arrow batches, a whole batch at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.wire import digests


def _bytes_udf(f, kind: T.DataType, arrow: pa.DataType):
    """An Arrow function of one binary column; null gives null."""

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v.encode() if isinstance(v, str) else v) for v in x.to_pylist()], arrow)

    return run


def _fnv(bits: int, kind: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        some = [v.encode() if isinstance(v, str) else v for v in x.to_pylist() if v is not None]
        hashes = iter(pa.array(digests.fnv1a_all(some, bits)).cast(arrow).to_pylist())
        return pa.array([None if gone else next(hashes) for gone in x.is_null().to_pylist()], arrow)

    return run


adler32 = _bytes_udf(lambda b: digests.adler32(b), T.LongType(), pa.int64())
crc16 = _bytes_udf(lambda b: digests.crc16(b), T.IntegerType(), pa.int32())
fnv1a_32 = _fnv(32, T.LongType(), pa.int64())
fnv1a_64 = _fnv(64, T.DecimalType(20, 0), pa.decimal128(20, 0))
escape = _bytes_udf(lambda b: digests.escape(b), T.StringType(), pa.string())
quote_escape = _bytes_udf(lambda b: digests.quote_escape(b), T.StringType(), pa.string())
hexdump = _bytes_udf(lambda b: digests.hexdump(b), T.StringType(), pa.string())
rle_compress = _bytes_udf(lambda b: digests.rle_compress(b), T.BinaryType(), pa.binary())
rle_decompress = _bytes_udf(lambda b: dict(zip(("status", "data"), digests.rle_decompress(b), strict=True)), T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.BinaryType())]), pa.struct([("status", pa.string()), ("data", pa.binary())]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def general_texts(x: pa.Array) -> pa.Array:
    """Each number of an array as C's %g writes it."""
    return pa.array([None if row is None else [None if v is None else f"{v:g}" for v in row] for row in x.to_pylist()], pa.list_(pa.string()))


def crc32(data: Column) -> Column:
    """Spark's own."""
    return F.crc32(data)


def _unsigned(x: pa.Array):
    """Decimals as an array of uint64, nulls as 0."""
    return x.fill_null(0).cast(pa.uint64()).to_numpy(zero_copy_only=False)


def _decimals(values, *sources: pa.Array) -> pa.Array:
    import functools

    import pyarrow.compute as pc

    gone = functools.reduce(pc.or_, [s.is_null() for s in sources])
    return pc.if_else(gone, pa.scalar(None, pa.decimal128(20, 0)), pa.array(values).cast(pa.decimal128(20, 0)))


@F.arrow_udf(T.DecimalType(20, 0))
def _mix64(x: pa.Array) -> pa.Array:
    return _decimals(digests.mix64(_unsigned(x)), x)


@F.arrow_udf(T.DecimalType(20, 0))
def _hash_combine(seed: pa.Array, value: pa.Array) -> pa.Array:
    return _decimals(digests.hash_combine(_unsigned(seed), _unsigned(value)), seed, value)


def mix64(x: Column) -> Column:
    """splitmix64 of an unsigned number."""
    return _mix64(x.cast("decimal(20,0)"))


def hash_combine(seed: Column, value: Column) -> Column:
    """A hash of two unsigned numbers; their order matters."""
    return _hash_combine(seed.cast("decimal(20,0)"), value.cast("decimal(20,0)"))


def utf8_valid(data: Column) -> Column:
    """Whether bytes are strict UTF-8: nothing overlong, no surrogates, nothing beyond U+10FFFF."""
    return F.is_valid_utf8(data.cast("string"))


def utf8_count(data: Column) -> Column:
    """The number of code points, null where the bytes are not UTF-8."""
    return F.when(utf8_valid(data), F.char_length(data.cast("string")).cast("long"))


def _one(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def utf8_decode(data: Column) -> Column:
    """struct<size, code_point> of the first code point; size 0 and no code point where there is none."""
    lead = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    size = lambda b: F.when(b < 0x80, 1).when((b >= 0xC2) & (b < 0xE0), 2).when((b >= 0xE0) & (b < 0xF0), 3).when((b >= 0xF0) & (b < 0xF5), 4).otherwise(0)

    def decoded(head, n):
        ok = (n > 0) & (F.octet_length(head) == n) & utf8_valid(head)
        return F.struct(F.when(ok, n).otherwise(0).alias("size"), F.when(ok, F.ascii(head.cast("string"))).alias("code_point"))

    found = _one(_one(lead, size), lambda n: _one(data.substr(F.lit(1), n), lambda head: decoded(head, n)))
    return F.when(data.isNotNull(), found)


def utf8_encode(code_point: Column) -> Column:
    """The bytes of a code point; null for surrogates and numbers beyond U+10FFFF."""
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))

    def encoded(c):
        tail = lambda shift: byte(F.shiftright(c, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)))
        lead = lambda shift, mark: byte(F.shiftright(c, shift).bitwiseOR(F.lit(mark)))
        two, three = F.concat(lead(6, 0xC0), tail(0)), F.concat(lead(12, 0xE0), tail(6), tail(0))
        four = F.concat(lead(18, 0xF0), tail(12), tail(6), tail(0))
        some = F.when(c < 0x80, byte(c)).when(c < 0x800, two).when(c < 0x10000, three).otherwise(four)
        return F.when((c >= 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF), some)

    return _one(code_point.cast("int"), encoded)


def to_hex(v: Column, digits: int = 1) -> Column:
    """'0x' and lower-case digits, padded to at least as many."""
    h = F.lower(F.hex(v.cast("long")))
    return F.concat(F.lit("0x"), F.when(F.length(h) < digits, F.lpad(h, digits, "0")).otherwise(h))


def codepoints(s: Column) -> Column:
    """The code points of a string or of bytes; null where they are not UTF-8."""
    text = s.cast("string")
    return F.when(F.is_valid_utf8(text), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)))


def big_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned number in size bytes from at (0-based); native, for fixed layouts."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("decimal(20,0)")


def little_endian(data: Column, at: int, size: int) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))]), 16, 10).cast("decimal(20,0)")


def bits(data: Column, at: int, count: int) -> Column:
    """The unsigned number in count bits (up to 48) from bit at on, the most significant of each byte first; null where there are fewer."""
    if not 0 < count <= 48:
        raise ValueError("1 to 48 bits at once")
    first, last = at // 8, -(-(at + count) // 8)
    window = F.conv(F.hex(F.substring(data, first + 1, last - first)), 16, 10).cast("long")
    value = F.shiftright(window, 8 * last - at - count).bitwiseAND(F.lit((1 << count) - 1).cast("long"))
    return F.when(F.octet_length(data) >= last, value)


SQL = {"adler32": adler32, "crc16": crc16, "fnv1a_32": fnv1a_32, "fnv1a_64": fnv1a_64, "mix64": _mix64, "hash_combine": _hash_combine, "bytes_escape": escape, "quote_escape": quote_escape, "hexdump": hexdump, "rle_compress": rle_compress, "rle_decompress": rle_decompress}


def register(spark: SparkSession) -> None:
    for name, f in SQL.items():
        spark.udf.register(name, f)
