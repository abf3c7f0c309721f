"""Functions and expressions on columns, over inputs that overflow, are not numbers or not UTF-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.functions import registry as functions
from tessera.operators import config

from .base import query, table

_BYTES = "list_transform(string_split(c_name, ''), lambda x: ascii(x)::bigint)"


@query(f"""
    with b as (select c_custkey, {_BYTES} as b, length(c_name) as n from customer)
    select c_custkey,
        xor(list_reduce(b, lambda c, x: list_reduce(range(8), lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end, xor(c, x)), 4294967295::bigint), 4294967295) as crc32,
        (((n + list_sum(list_transform(range(n), lambda i: (n - i) * b[i + 1]))) % 65521) * 65536 + (1 + list_sum(b)) % 65521)::bigint as adler32,
        list_reduce(b, lambda c, x: list_reduce(range(8), lambda d, k: case when d & 32768 <> 0 then xor((d << 1) & 65535, 4129) else (d << 1) & 65535 end, xor(c, x << 8)), 65535::bigint)::int as crc16,
        list_reduce(b, lambda h, x: (xor(h, x) * 16777619) % 4294967296, 2166136261::bigint) as fnv1a_32,
        list_reduce(list_transform(b, lambda x: x::ubigint), lambda h, x: ((xor(h, x)::uhugeint * 1099511628211) % 18446744073709551616)::ubigint, 14695981039346656037::ubigint)::varchar as fnv1a_64
    from b""")
def hashes(spark, sf_dir):
    r, b = functions, F.col("c_name").cast("binary")
    return table(spark, sf_dir, "customer").select("c_custkey", r.crc32(b).alias("crc32"), r.adler32(b).alias("adler32"), r.crc16(b).alias("crc16"), r.fnv1a_32(b).alias("fnv1a_32"), r.fnv1a_64(b).cast("string").alias("fnv1a_64"))


def _mix(x: str) -> str:
    """SQL of splitmix64 for a ubigint expression, in steps of nested queries."""
    wrap = lambda e: f"(({e}) % 18446744073709551616)::ubigint"
    a = wrap(f"({x})::uhugeint + 11400714819323198485")
    b = wrap(f"xor({a}, {a} >> 30)::uhugeint * 13787848793156543929")
    c = wrap(f"xor({b}, {b} >> 27)::uhugeint * 10723151780598845931")
    return f"xor({c}, {c} >> 31)"


@query(f"""
    with m as (select c_custkey, c_nationkey, {_mix("c_custkey::ubigint")} as mix, {_mix("c_nationkey::ubigint")} as other from customer)
    select c_custkey, mix::varchar as mix64, xor(mix, ((other::uhugeint + 11400714819323198485 + ((mix::uhugeint * 64) % 18446744073709551616) + (mix >> 2)) % 18446744073709551616)::ubigint)::varchar as combined from m""")
def mixes(spark, sf_dir):
    """splitmix64, and a hash of two values."""
    mix = functions.mix64(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", mix.cast("string").alias("mix64"), functions.hash_combine(mix, F.col("c_nationkey")).cast("string").alias("combined"))


@query(r"""
    with s as (select c_custkey as k, case c_custkey % 8 when 0 then 'é' when 1 then '€' when 2 then '😀' else 'a' end as c from customer),
    b as (select k, c, k % 8 < 4 as ok from s)
    select k as c_custkey, ok as valid, case when ok then 2 end as n, case when k % 8 < 4 then strlen(c) else case when k % 8 = 4 then 1 else 0 end end::int as size,
        case when k % 8 < 4 then unicode(c) when k % 8 = 4 then 97 end as code_point, case when k % 8 < 4 then hex(encode(c)) end as encoded, case when ok then [unicode(c), 122] end as points from b""")
def utf8(spark, sf_dir):
    """Valid and broken UTF-8: code points of one to four bytes, overlong, a surrogate, cut short, beyond the last code point."""
    k = F.col("c_custkey") % 8
    first = F.when(k == 0, "C3A9").when(k == 1, "E282AC").when(k == 2, "F09F9880").when(k == 3, "61").when(k == 4, "61C0AF").when(k == 5, "EDA080").when(k == 6, "E282").otherwise("F4908080")
    data = F.unhex(F.concat(first, F.lit("7A")))
    head = functions.utf8_decode(data)
    illegal = F.when(k == 4, 0xD800).when(k == 5, 0xDFFF).when(k == 6, 0x110000).otherwise(-1)
    back = functions.utf8_encode(F.when(k < 4, head["code_point"]).otherwise(illegal))
    return table(spark, sf_dir, "customer").select("c_custkey", functions.utf8_valid(data).alias("valid"), functions.utf8_count(data).cast("int").alias("n"), head["size"].alias("size"), head["code_point"].alias("code_point"), F.hex(back).alias("encoded"), functions.codepoints(data).alias("points"))


@query(r"""
    select c_custkey, c_name || '\x0a"\\' || '\xff' as escaped, c_name || '\n\"\\' || '\xff' as quoted, '0x' || lower(hex(c_custkey)) as hex_short, '0x' || lpad(lower(hex(c_custkey)), 12, '0') as hex_long,
        '0x00000000  ' || array_to_string(list_transform(string_split(c_name[1:16], ''), lambda x: lower(hex(x))), ' ') || '  ' || c_name[1:16] || e'\n0x00000010  ' || rpad(array_to_string(list_transform(string_split(c_name[17:], ''), lambda x: lower(hex(x))), ' ') || ' 0a', 48, ' ') || ' ' || c_name[17:] || e'.\n' as dump
    from customer""")
def escapes(spark, sf_dir):
    name = F.col("c_name").cast("binary")
    odd = F.concat(name, F.unhex(F.lit("0A225CFF")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", functions.escape(odd).alias("escaped"), functions.quote_escape(odd).alias("quoted"), functions.to_hex(F.col("c_custkey")).alias("hex_short"),
        functions.to_hex(F.col("c_custkey"), 12).alias("hex_long"), functions.hexdump(F.concat(name, F.unhex(F.lit("0A")))).alias("dump"),
    )


@query("""
    with r as (select c_custkey, c_custkey % 300 as n, c_name from customer),
    s as (select *, n // 128 as whole, n % 128 as rest from r)
    select c_custkey, repeat('FF61', whole) || case when rest > 1 then upper(lpad(to_hex(127 + rest), 2, '0')) || '61' else '' end
            || case when rest = 1 then '03' || '61' else '02' end || '62' || '63' || '64' || '8179' as packed,
        'OK' as status, repeat('a', n) || 'bcdyy' as data, 'MALFORMED' as cut from s""")
def run_lengths(spark, sf_dir):
    """Runs of up to 128 bytes, literals between them, and back; a cut token is malformed."""
    data = F.concat(F.expr("repeat('a', cast(c_custkey % 300 as int))"), F.lit("bcdyy")).cast("binary")
    packed = functions.rle_compress(data)
    back = functions.rle_decompress(packed)
    cut = functions.rle_decompress(F.concat(packed, F.unhex(F.lit("05"))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(packed).alias("packed"), back["status"].alias("status"), back["data"].cast("string").alias("data"), cut["status"].alias("cut"))


@query("""
    select n_nationkey, (ascii(n_name[1]) * 256 + ascii(n_name[2]))::varchar as big, (ascii(n_name[2]) * 256 + ascii(n_name[1]))::varchar as little, (ascii(n_name[4]) * 16777216::bigint + ascii(n_name[3]) * 65536 + ascii(n_name[2]) * 256 + ascii(n_name[1]))::varchar as little_4 from nation""")
def byte_numbers(spark, sf_dir):
    name = F.col("n_name").cast("binary")
    return table(spark, sf_dir, "nation").select("n_nationkey", functions.big_endian(name, 0, 2).cast("string").alias("big"), functions.little_endian(name, 0, 2).cast("string").alias("little"), functions.little_endian(name, 0, 4).cast("string").alias("little_4"))


@query("""
    with b as (select n_nationkey, length(n_name) as n, ascii(n_name[1])::bigint * 65536 + ascii(n_name[2]) * 256 + ascii(n_name[3]) as x from nation)
    select n_nationkey, x >> 23 as one, (x >> 17) & 63 as six, (x >> 5) & 2047 as eleven, case when n >= 7 then 0 else null end as past from b""")
def bit_fields(spark, sf_dir):
    """Bits across bytes, the most significant first; beyond the end there are none."""
    name = F.col("n_name").cast("binary")
    of = functions.bits
    return table(spark, sf_dir, "nation").select("n_nationkey", of(name, 0, 1).alias("one"), of(name, 1, 6).alias("six"), of(name, 8, 11).alias("eleven"), of(name, 48, 1).cast("int").alias("past"))


def _wrap(e: str) -> str:
    """SQL of a hugeint brought into 64 signed bits."""
    low = f"(((({e}) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616)"
    return f"(case when {low} >= 9223372036854775808 then {low} - 18446744073709551616 else {low} end)::bigint"


@query(f"""
    with v as (select c_custkey, 9223372036854775807 - c_custkey as a, c_custkey * 1000003 + 77 as b, (c_custkey * 2862933555777::bigint) as m, (-9223372036854775808)::bigint as low from customer)
    select c_custkey, {_wrap("a::hugeint + b")} as plus, {_wrap("(-a)::hugeint - b")} as minus, {_wrap("a::hugeint * b")} as times, {_wrap("m::hugeint * m")} as square, low as neg, low as div_minus_one, 0::bigint as mod_minus_one,
        (-a) // b as quotient, (-a) % b as remainder, {_wrap("b::hugeint * 4294967296 * 65536")} as shifted, (-a) >> 7 as right_shift, xor(a, m) as bits, ~b as flipped
    from v""")
def expr_wrap(spark, sf_dir):
    """64-bit arithmetic that wraps, at and beyond its limits."""
    n = lambda k: F.lit(k).cast("long")
    v = table(spark, sf_dir, "customer").select("c_custkey", (n(2**63 - 1) - F.col("c_custkey")).alias("a"), (F.col("c_custkey") * 1000003 + 77).alias("b"), (F.col("c_custkey") * 2862933555777).alias("m"), n(-(2**63)).alias("low"))
    a, b, m, low = (F.col(c) for c in ("a", "b", "m", "low"))
    return v.select(
        "c_custkey", expr.add(a, b).alias("plus"), expr.subtract(-a, b).alias("minus"), expr.multiply(a, b).alias("times"), expr.multiply(m, m).alias("square"), expr.negate(low).alias("neg"),
        expr.divide(low, n(-1)).alias("div_minus_one"), expr.remainder(low, n(-1)).alias("mod_minus_one"), expr.divide(-a, b).alias("quotient"), expr.remainder(-a, b).alias("remainder"),
        expr.shift_left(b, n(48)).alias("shifted"), expr.shift_right(-a, n(7)).alias("right_shift"), expr.bit_xor(a, m).alias("bits"), expr.bit_not(b).alias("flipped"),
    )


@query("""
    with v as (select event_id, case event_id % 5 when 0 then 'NaN'::double when 1 then 0.0 when 2 then null else value end as x, event_id % 3 - 1.0 as y, case when event_id % 4 = 0 then null else event_type end as s from events)
    select event_id, coalesce(x <> 0, false) as truthy, coalesce(s <> '', false) as filled, case when x is null then false when isnan(x) then true else x = y end as same, case when x is null then false when isnan(x) then false else x < y end as less,
        coalesce(x <> 0, false) and coalesce(s <> '', false) as both, not coalesce(x <> 0, false) as negated, s is not distinct from null as is_null,
        coalesce(s, 'null') || case when x is null then 'null' when isnan(x) then 'nan' else format('{:.6f}', x) end as joined, case when y = 0 then null else 1.5 / y end as quotient from v""")
def expr_nan(spark, sf_dir):
    """NaN is equal to every number and counts as true; null is false, and equal to null only."""
    k = F.col("event_id")
    x = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, 0.0).when(k % 5 == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    v = table(spark, sf_dir, "events").select("event_id", x.alias("x"), (k % 3 - 1.0).cast("double").alias("y"), F.when(k % 4 != 0, F.col("event_type")).alias("s"))
    x, y, s = (F.col(c) for c in ("x", "y", "s"))
    return v.select(
        "event_id", expr.truthy(x, "float").alias("truthy"), expr.truthy(s, "string").alias("filled"), expr.equal(x, y, numbers=True).alias("same"),
        expr.choose(x.isNull(), F.lit(False), expr.compared_numbers(x, y) < 0).alias("less"), expr.both(expr.truthy(x, "float"), expr.truthy(s, "string")).alias("both"),
        expr.negated(expr.truthy(x, "float")).alias("negated"), expr.equal(s, F.lit(None).cast("string")).alias("is_null"), expr.concatenated(s, x, ("string", "float")).alias("joined"),
        expr.choose(y == 0, F.lit(None).cast("double"), expr.divide_float(F.lit(1.5), y)).alias("quotient"),
    )


@query("""
    select kind, count(*) as n from (select 'TYPE_MISMATCH' as kind from customer where c_custkey % 3 = 0 union all select 'MISSING_REQUIRED' from customer where c_custkey % 4 = 0) group by kind""")
def rule_types(spark, sf_dir):
    """A type rule on texts beside a required one."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "x").otherwise(k.cast("string")).alias("number"), F.when(k % 4 != 0, "y").alias("there"))
    return config.Schema().typed("number", "int").require("there").violations(rows, ["c_custkey"]).groupBy("kind").agg(F.count("*").alias("n"))
