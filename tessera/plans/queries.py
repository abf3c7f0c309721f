"""Driver queries: the operators applied to the parquet tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.functions import registry as functions
from tessera.operators import config, journal, lookup, sequences, tree

from .base import ORACLE, QUERIES
from .base import query as _query
from .base import table as _t


@_query("""
    select user_id, arg_max(value, event_id) as value, max(event_id) as event_id from events
    group by user_id having arg_max(event_type, event_id) <> 'error'""")
def wal_replay(spark, sf_dir):
    return journal.replay(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error", ["value"])


_OPS = """
    with ops as (select user_id, event_id, value, event_id % 10 as k,
        case event_type when 'signup' then 'BEGIN' when 'purchase' then 'COMMIT' when 'error' then 'ROLLBACK' else 'INSERT' end as op from events),
    c as (select *, case when op <> 'INSERT' then op end as ctl from ops),
    b as (select *, last_value(ctl ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as bef,
        first_value(ctl ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as aft from c),
    o as (select *, case when coalesce(bef, '') <> 'BEGIN' then 'AUTO' when aft = 'COMMIT' then 'COMMITTED' when aft = 'BEGIN' then 'DROPPED' else 'ROLLED_BACK' end as outcome
        from b where ctl is null)"""


def _ops(spark, sf_dir, chunk=None):
    kind = F.when(F.col("event_type") == "signup", "BEGIN").when(F.col("event_type") == "purchase", "COMMIT").when(F.col("event_type") == "error", "ROLLBACK").otherwise("INSERT")
    ops = _t(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 10).alias("k"), kind.alias("op"))
    return journal.outcomes(ops, ["user_id"], "event_id", chunk=chunk).where("outcome is not null")


@_query(_OPS + " select outcome, count(*) as n from o group by outcome")
def txn_outcomes(spark, sf_dir):
    return _ops(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@_query(_OPS + " select outcome, count(*) as n from o group by outcome")
def txn_outcomes_chunked(spark, sf_dir):
    """txn_outcomes for streams too long for one task: windows over chunks of the journal."""
    return _ops(spark, sf_dir, chunk=500).groupBy("outcome").agg(F.count("*").alias("n"))


@_query(_OPS + " select user_id, k, arg_max(value, event_id) as value, max(event_id) as event_id from o where outcome in ('AUTO', 'COMMITTED') group by user_id, k")
def txn_replay(spark, sf_dir):
    kept = _ops(spark, sf_dir).where(F.col("outcome").isin("AUTO", "COMMITTED"))
    return journal.replay(kept, ["user_id", "k"], "event_id", F.lit(False), ["value"])


@_query("""
    with e as (select user_id, event_id, (event_id // 64) % 65536 as seq, event_type = 'error' as is_reset from events),
    p as (select *, coalesce(sum(is_reset::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as epoch from e),
    l as (select *, lag(seq) over (partition by user_id, epoch order by event_id) as prev from p)
    select user_id, count(*) as frames, count(*) filter (seq <> prev and seq <> (prev + 1) % 65536) as gaps, count(*) filter (seq = prev) as dups, count(*) filter (is_reset) as resets
    from l group by user_id""")
def seq_gap_dup(spark, sf_dir):
    frames = _t(spark, sf_dir, "events").withColumn("seq", F.expr("(event_id div 64) % 65536"))
    return sequences.stream_stats(sequences.observe(frames, ["user_id"], "event_id", "seq", F.col("event_type") == "error"), ["user_id"])


@_query(ORACLE["seq_gap_dup"])
def seq_gap_dup_chunked(spark, sf_dir):
    """seq_gap_dup for streams too long for one task."""
    frames = _t(spark, sf_dir, "events").withColumn("seq", F.expr("(event_id div 64) % 65536"))
    return sequences.stream_stats(sequences.observe(frames, ["user_id"], "event_id", "seq", F.col("event_type") == "error", chunk=500), ["user_id"])


_ISLANDS = """
    with r as (select distinct l_orderkey, l_linenumber - 1 as b, l_linenumber as e from lineitem),
    s as (select *, case when b > max(e) over (partition by l_orderkey order by b, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as nw from r),
    i as (select *, sum(nw) over (partition by l_orderkey order by b, e rows unbounded preceding) as g from s),
    u as (select l_orderkey, g, min(b) as lo, max(e) as hi from i group by l_orderkey, g)"""


def _line_ranges(spark, sf_dir):
    # Equal ranges add nothing to a union, so they are combined before the shuffle.
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("b"), F.col("l_linenumber").alias("e")).distinct()
    return sequences.coalesce_ranges(lines, ["l_orderkey"], "b", "e")


@_query(_ISLANDS + " select l_orderkey, lo, hi from u")
def range_coalesce(spark, sf_dir):
    return _line_ranges(spark, sf_dir)


@_query(_ISLANDS + " select l_orderkey, count(*) as islands, max(hi) as length, count(*) = 1 and min(lo) = 0 as is_complete from u group by l_orderkey")
def range_complete(spark, sf_dir):
    return sequences.complete(_line_ranges(spark, sf_dir), ["l_orderkey"])


@_query("""
    with f as (select l_orderkey, l_linenumber, max(l_quantity)::bigint as q from lineitem group by l_orderkey, l_linenumber)
    select l_orderkey, count(*) as fragments, sum(q)::bigint as total from f group by l_orderkey having count(*) = max(l_linenumber)""")
def fragment_complete(spark, sf_dir):
    parts = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"))
    return sequences.whole_messages(parts, ["l_orderkey"], "l_linenumber", "q")


@_query("""
    with m as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as msg_id,
        row_number() over (partition by user_id order by (event_id * 7919) % 10007, event_id) as arrival from events),
    c as (select *, msg_id < arg_min(msg_id, arrival) over (partition by user_id) as is_dup from m)
    select user_id, event_id, msg_id, arrival, is_dup,
        case when not is_dup then max(case when not is_dup then arrival end) over (partition by user_id order by msg_id rows unbounded preceding) end as released_at from c""")
def ordered_delivery(spark, sf_dir):
    rank = lambda order: F.expr(f"cast(row_number() over (partition by user_id order by {order}) as bigint)")
    messages = _t(spark, sf_dir, "events").select("user_id", "event_id", rank("event_id").alias("msg_id"), rank("(event_id * 7919) % 10007, event_id").alias("arrival"))
    return sequences.ordered_delivery(messages, ["user_id"], "msg_id", "arrival")


@_query("""
    with e as (select user_id, event_id, case when event_type = 'signup' then floor(value)::bigint * 10 end as win, case when event_type <> 'signup' then floor(value)::bigint else 0 end as n from events),
    a as (select *, coalesce(max(win) over w, 0) as adv, sum(n) over w as s from e window w as (partition by user_id order by event_id rows unbounded preceding)),
    t as (select *, (s + least(0, min(adv - s) over (partition by user_id order by event_id rows unbounded preceding)))::bigint as sent from a),
    d as (select *, sent - coalesce(lag(sent) over (partition by user_id order by event_id), 0) as admitted from t)
    select user_id, event_id, sent, admitted, admitted < n as blocked from d""")
def flow_control(spark, sf_dir):
    amount, update = F.floor("value").cast("long"), F.col("event_type") == "signup"
    done = sequences.flow_control(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.when(update, amount * 10), F.when(update, F.lit(0)).otherwise(amount))
    return done.select("user_id", "event_id", "sent", "admitted", "blocked")


@_query("""
    with c as (select user_id, event_id, event_type, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as nw from events),
    r as (select *, sum(nw) over (partition by user_id order by event_id rows unbounded preceding) as run from c),
    p as (select *, (row_number() over (partition by user_id, run order by event_id) - 1) // 3 as part from r)
    select user_id, event_type, min(event_id) as first, count(*) as n from p group by user_id, run, part, event_type""")
def rle_runs(spark, sf_dir):
    return sequences.runs(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", 3)


@_query("""
    select c_custkey, c_nationkey, n_nationkey is not null as ref_resolved, coalesce(n_name, '#' || c_nationkey) as text
    from customer left join (select * from nation where n_nationkey < 20) n on c_nationkey = n_nationkey""")
def string_ref_join(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").where("n_nationkey < 20")
    return lookup.resolve(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "n_nationkey", "n_name")


@_query("select p_brand, arg_min(p_name, p_partkey) as p_name, min(p_partkey) as p_partkey from part where p_brand = 'Brand#12' group by p_brand")
def index_lookup(spark, sf_dir):
    return lookup.first_match(lookup.key_range(_t(spark, sf_dir, "part"), "p_brand", "Brand#12", "Brand#12"), ["p_brand"], "p_partkey", ["p_name"])


@_query("select p_brand, p_partkey, p_name from part where p_brand between 'Brand#12' and 'Brand#15' order by p_brand, p_partkey")
def index_range(spark, sf_dir):
    return lookup.key_range(_t(spark, sf_dir, "part"), "p_brand", "Brand#12", "Brand#15").select("p_brand", "p_partkey", "p_name").orderBy("p_brand", "p_partkey")


@_query("""
    select p_partkey, count(*) as n, sum(round(l_extendedprice * 100)::bigint)::bigint as cents
    from part join lineitem on p_partkey = l_partkey where p_brand between 'Brand#12' and 'Brand#15' group by p_partkey""")
def locator_join(spark, sf_dir):
    index = lookup.key_range(_t(spark, sf_dir, "part"), "p_brand", "Brand#12", "Brand#15").select("p_partkey")
    # Aggregated before the join: each part's lines shrink to one row where they are read.
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return index.join(lines, "p_partkey")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@_query(f"""
    select {", ".join(_LINE)} from lineitem where (l_orderkey, l_linenumber) >= (1000, 3)
    order by {", ".join(_LINE)} limit 100""")
def cursor_seek(spark, sf_dir):
    return lookup.seek(_t(spark, sf_dir, "lineitem").select(*_LINE), _LINE[:2], [1000, 3], _LINE[2:], 100)


@_query("""
    select v.event_type, coalesce(n, 0) as n from (values ('signup'), ('purchase'), ('error'), ('view'), ('click'), ('refund')) v(event_type)
    left join (select event_type, count(*) as n from events group by event_type) e on v.event_type = e.event_type""")
def type_histogram(spark, sf_dir):
    return lookup.histogram(_t(spark, sf_dir, "events"), "event_type", ["signup", "purchase", "error", "view", "click", "refund"])


@_query("""
    select lang, count(text) as n, sum(strlen(text))::bigint as total_bytes, max(strlen(text)) as max_bytes, count(*) filter (strlen(text) = 0) as empties
    from documents group by lang""")
def string_stats(spark, sf_dir):
    return lookup.string_stats(_t(spark, sf_dir, "documents"), ["lang"], "text")


@_query("""
    select count(*) as frames, count(*) filter (event_type = 'signup') as control, count(*) filter (event_type = 'click') as acks,
        count(*) filter (event_type = 'error') as resets, count(*) filter (value < 1) as small, bool_and(value >= 0) as all_ok from events""")
def conditional_counters(spark, sf_dir):
    counted = sequences.decode_counters(_t(spark, sf_dir, "events"), [], "event_type", F.col("value") >= 1, control="signup", acks="click", resets="error")
    low = _t(spark, sf_dir, "events").agg(F.every(F.col("value") >= 0).alias("all_ok"))
    # Both sides are one row.
    return counted.crossJoin(low).select("frames", "control", "acks", "resets", F.col("crc_bad").alias("small"), "all_ok")


@_query("""
    select event_id, k as path, json_extract_string(props, '$.' || k) as text
    from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def flatten_props(spark, sf_dir):
    return config.flatten_map(_t(spark, sf_dir, "events"), ["event_id"], "props")


@_query("""
    with a as (select 'customer[' || c_custkey || '].segment' as path, c_mktsegment as old from customer where c_custkey % 7 <> 0),
    b as (select 'customer[' || c_custkey || '].segment' as path, case when c_custkey % 3 = 0 then c_mktsegment || '!' else c_mktsegment end as new from customer where c_custkey % 5 <> 0)
    select coalesce(a.path, b.path) as path, case when b.path is null then 'REMOVED' when a.path is null then 'ADDED' else 'CHANGED' end as kind, old, new
    from a full join b on a.path = b.path where old is distinct from new""")
def config_diff(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("customer["), F.col("c_custkey").cast("string"), F.lit("].segment")).alias("path"), F.col("c_mktsegment").alias("v"))
    after = c.where("c_custkey % 5 <> 0").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return config.diff(c.where("c_custkey % 7 <> 0"), after, "path", "v", "c_custkey")


@_query("""
    select rule, kind, count(*) as n from (
        select 'o_totalprice' as rule, 'BELOW_MIN' as kind from orders where o_totalprice < 50000
        union all select 'o_totalprice', 'ABOVE_MAX' from orders where o_totalprice > 300000
        union all select 'o_orderstatus', 'NOT_ALLOWED' from orders where o_orderstatus not in ('O', 'F')
        union all select 'o_orderpriority', 'MISSING_REQUIRED' from orders where o_orderpriority is null) group by rule, kind""")
def rule_validate(spark, sf_dir):
    schema = config.Schema().require("o_orderpriority").at_least("o_totalprice", 50000).at_most("o_totalprice", 300000).one_of("o_orderstatus", ["O", "F"])
    return schema.violations(_t(spark, sf_dir, "orders"), ["o_orderkey"]).groupBy("rule", "kind").agg(F.count("*").alias("n"))


@_query("select event_type, arg_min(user_id, event_id) as user_id, arg_min(value, event_id) as value, min(event_id) as event_id from events group by event_type")
def first_match(spark, sf_dir):
    return lookup.first_match(_t(spark, sf_dir, "events"), ["event_type"], "event_id", ["user_id", "value"])


@_query("""
    select conv_id, turn, role, occurrence from (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn, text) as occurrence from conversations) where occurrence > 1""")
def duplicate_keys(spark, sf_dir):
    return lookup.repeated(_t(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "turn", "role", F.col("occurrence").cast("long").alias("occurrence"))


@_query("select doc_id, n_chars as declared, strlen(text) as actual from documents where n_chars <> strlen(text)")
def count_mismatch(spark, sf_dir):
    held = [F.lit("DATA").alias("type"), F.lit(0).alias("section_idx"), F.col("n_chars").alias("item_count"), F.octet_length("text").cast("long").alias("records")]
    found = tree.item_count_mismatches(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), *held))
    return found.select(F.col("path").alias("doc_id"), F.col("item_count").alias("declared"), F.col("records").alias("actual"))


@_query("select l_orderkey, max(l_linenumber)::bigint as declared, count(*) as actual from lineitem group by l_orderkey having count(*) <> max(l_linenumber)")
def count_mismatch_orders(spark, sf_dir):
    counted = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_linenumber").cast("long").alias("item_count"), F.count("*").alias("records"))
    found = tree.item_count_mismatches(counted.select("path", F.lit("DATA").alias("type"), F.lit(0).alias("section_idx"), "item_count", "records"))
    return found.select(F.col("path").alias("l_orderkey"), F.col("item_count").alias("declared"), F.col("records").alias("actual"))


@_query("""
    select vec_id, (i - 1)::int as ordinal, embedding[i]::double as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)
    where embedding[i] > 0.25 order by vec_id, ordinal""")
def collect_nodes(spark, sf_dir):
    nodes = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.lit(0).alias("section_idx"), F.lit(0).alias("depth"), F.lit("FLOAT").alias("tag"), F.posexplode("embedding").alias("pre_order", "v"))
    found = tree.collect_records(nodes.withColumn("f64", F.col("v").cast("double")).where("f64 > 0.25"), "FLOAT", recursive=False, section=0)
    return found.select(F.col("path").alias("vec_id"), F.col("pre_order").alias("ordinal"), F.col("f64").alias("value"))


_CHAIN = """
    with recursive chain(start, page, hop, visited, status) as (
        select n_nationkey, n_nationkey, 0, {one}, 'OPEN' from nation
        union all
        select start, (page * 7 + 3) % 30, hop + 1, {more},
            case when {seen} then 'CYCLE' when (page * 7 + 3) % 30 >= 25 then 'DANGLING_PAGE' else 'OPEN' end
        from chain where status = 'OPEN' and hop < 60)
    select start, hop, page as stopped_at, status from chain where status <> 'OPEN'"""


@_query(_CHAIN.format(one="[n_nationkey]", more="list_append(visited, (page * 7 + 3) % 30)", seen="list_contains(visited, (page * 7 + 3) % 30)"))
def chain_walk(spark, sf_dir):
    pages = _t(spark, sf_dir, "nation").selectExpr("n_nationkey as page", "(n_nationkey * 7 + 3) % 30 as next")
    return lookup.walk_chains(pages, pages.select(F.col("page").alias("start")), 60)


@_query("""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey - 1000) // 7 as q, (l_partkey - 1000) % 7 as r,
        l_partkey * 3 - l_suppkey as a, -l_partkey as neg, round(l_quantity / 8, 6) as d from lineitem""")
def expr_arith(spark, sf_dir):
    part, supplier, seven, low = F.col("l_partkey"), F.col("l_suppkey"), F.lit(7).cast("long"), F.lit(1000).cast("long")
    less = expr.subtract(part, low)
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expr.divide(less, seven).alias("q"), expr.remainder(less, seven).alias("r"),
        expr.subtract(expr.multiply(part, F.lit(3).cast("long")), supplier).alias("a"), expr.negate(part).alias("neg"), F.round(expr.divide_float(F.col("l_quantity"), F.lit(8)), 6).alias("d"),
    )


@_query("""
    select l_orderkey, l_linenumber, l_partkey & 255 as a, l_partkey | 15 as o, xor(l_partkey, l_suppkey) as x, ~l_partkey as n,
        l_partkey << 3 as sl, l_partkey >> 2 as sr from lineitem""")
def expr_bitwise(spark, sf_dir):
    part, supplier, n = F.col("l_partkey"), F.col("l_suppkey"), lambda k: F.lit(k).cast("long")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", expr.bit_and(part, n(255)).alias("a"), expr.bit_or(part, n(15)).alias("o"), expr.bit_xor(part, supplier).alias("x"), expr.bit_not(part).alias("n"),
        expr.shift_left(part, n(3)).alias("sl"), expr.shift_right(part, n(2)).alias("sr"),
    )


@_query("""
    select event_id, value <> 0 and event_type <> '' as both, value < 1 or event_type = 'error' as either, not (value > 10) as neg,
        case when value > 10 then 'big' when value > 1 then 'mid' else 'low' end as pick, event_type <= 'error' as le, (case when user_id % 2 = 0 then null else user_id end) is not distinct from null as eq from events""")
def expr_logic(spark, sf_dir):
    value, kind = F.col("value"), F.col("event_type")
    above = lambda k: expr.compared_numbers(value, F.lit(k)) > 0
    return _t(spark, sf_dir, "events").select(
        "event_id", expr.both(expr.truthy(value, "float"), expr.truthy(kind, "string")).alias("both"),
        expr.either(expr.compared_numbers(value, F.lit(1)) < 0, expr.equal(kind, F.lit("error"))).alias("either"), expr.negated(above(10)).alias("neg"),
        expr.choose(above(10), F.lit("big"), expr.choose(above(1), F.lit("mid"), F.lit("low"))).alias("pick"), (expr.compared(kind, F.lit("error")) <= 0).alias("le"),
        expr.equal(F.expr("case when user_id % 2 = 0 then null else user_id end"), F.lit(None).cast("long")).alias("eq"),
    )


@_query("select doc_id, length(text) as code_points, strlen(text) as bytes, strlen(text) = length(text) as is_ascii from documents")
def utf8_stats(spark, sf_dir):
    count, size = functions.utf8_count(F.col("text").cast("binary")), F.octet_length("text").cast("long")
    return _t(spark, sf_dir, "documents").select("doc_id", count.alias("code_points"), size.alias("bytes"), (size == count).alias("is_ascii"))


@_query("select doc_id, '0x' || lower(lpad(to_hex(doc_id), 8, '0')) as id_hex, lower(hex(encode(left(text, 16)))) as head_hex from documents")
def hex_escape(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", functions.to_hex(F.col("doc_id"), 8).alias("id_hex"), F.lower(F.hex(F.substring("text", 1, 16).cast("binary"))).alias("head_hex"))


@_query("select doc_id, lower(hex(encode(text))) as text_hex from documents")
def hex_text(spark, sf_dir):
    """hex_escape renders heads only, as its SQL says; this one renders whole texts."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("text_hex"))


@_query("""
    select doc_id, i::int as frag_idx, (i * 1000)::int as frag_offset, substr(text, (i * 1000 + 1)::bigint, 1000) as fragment, i = greatest(1, ceil(length(text) / 1000.0))::bigint - 1 as is_fin
    from (select doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 1000.0))::bigint)) as i from documents)""")
def fragment_encode(spark, sf_dir):
    return sequences.fragments(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000).drop("text")


@_query("""
    select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents
    from events group by all""")
def event_windows(spark, sf_dir):
    """Spark-supplied (the formats have no clock): tumbling event-time windows."""
    w = _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@_query("""
    select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity)::bigint as qty from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_counts(spark, sf_dir):
    """Spark-supplied: grouping sets."""
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@_query()
def checksums(spark, sf_dir):
    """Hashes that SQL engines lack; tested against the plain functions."""
    r, b = functions, F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", r.crc32(b).alias("crc32"), r.adler32(b).alias("adler32"), r.crc16(b).alias("crc16"), r.fnv1a_64(b).alias("fnv1a_64"))


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a file source wants a folder
    return source.parquet(path)


def _folder(spark, what):
    import os
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-stream-")
    return os.path.join(base, f"{what}-{uuid.uuid4().hex}")


@_query(ORACLE["seq_gap_dup"])
def stream_seq_gap_dup(spark, sf_dir):
    """seq_gap_dup through Structured Streaming: running counters by a stateful fold, one row a stream and micro-batch, of which the last stays."""
    from tessera.streaming.folds import drain, fold_stream
    from tessera.wire.folds import SequenceFold

    frames = _stream(spark, sf_dir, "events").selectExpr("user_id", "event_id", "(event_id div 64) % 65536 as seq", "event_type = 'error' as is_reset")
    running = drain(fold_stream(frames, ["user_id"], "event_id", SequenceFold, "user_id long", last=True), _folder(spark, "seq"))
    return running.groupBy("user_id").agg(F.max_by(F.struct("frames", "gaps", "dups", "resets"), "frames").alias("s")).select("user_id", "s.frames", "s.gaps", "s.dups", "s.resets")


@_query(ORACLE["wal_replay"])
def stream_wal_replay(spark, sf_dir):
    """wal_replay through Structured Streaming: a stateful fold passes on what takes effect, the last of each key stays."""
    from tessera.operators.journal import replay
    from tessera.streaming.folds import drain, fold_stream
    from tessera.wire.folds import JournalFold

    ops = _stream(spark, sf_dir, "events").selectExpr("user_id", "event_id as page", "0L as slot", "if(event_type = 'error', 'DELETE', 'INSERT') as op", "cast(cast(value as string) as binary) as bytes")
    done = drain(fold_stream(ops, ["user_id"], "page", JournalFold, "user_id long"), _folder(spark, "wal"))
    last = replay(done.withColumnRenamed("page", "event_id"), ["user_id"], "event_id", F.col("bytes").isNull(), ["bytes"])
    return last.select("user_id", F.col("bytes").cast("string").cast("double").alias("value"), "event_id")


@_query("""
    with m as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as msg_id from events)
    select user_id, msg_id from m""")
def delivery_fold(spark, sf_dir):
    """Count-bounded delivery as a stateful fold in batch: all messages arrive, so all are released once."""
    from tessera.streaming.folds import fold_batch
    from tessera.wire.folds import DeliveryFold

    messages = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(row_number() over (partition by user_id order by event_id) as bigint) as msg_id")
    return fold_batch(messages, ["user_id"], "event_id", DeliveryFold, "user_id long").select("user_id", "msg_id")


from . import format_queries, function_queries  # noqa: E402, F401  they add to the registry
