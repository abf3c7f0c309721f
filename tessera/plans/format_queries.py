"""Round trips through the four formats: tables become files in memory, the decoders' views are compared with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import config, lookup, sequences, tree
from tessera.sources import formats, sinks
from tessera.wire import bpk, cfg, folds, frames, mdb

from .base import encoded, query, table

_CUSTOMERS = "select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i from customer"


def _items(rows, path, order: str, *columns: str):
    """(path, items): the rows of each path in order, dealt to all cores, as making files of them takes more time than their size tells."""
    dealt = rows.withColumn("path", path).repartition(rows.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("items"))


def _customers(spark, sf_dir):
    path = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
    return _items(table(spark, sf_dir, "customer"), path, "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


# -- containers --------------------------------------------------------------------------------


def _container(path, customers):
    """A container of a nation: a group of 9 nodes for each customer, metadata, and a section of which odd nations get a wrong byte."""
    nation = customers[0]["c_nationkey"]
    groups = [
        ("GROUP", [("UINT", c["c_custkey"]), ("STRING", c["c_name"].encode()), ("FLOAT", c["c_acctbal"]), ("KEYVAL", (b"segment", ("STRING", c["c_mktsegment"].encode()))), ("ARRAY", [("INT", -c["c_custkey"]), ("INT", c["c_custkey"] % 7)])])
        for c in customers
    ]
    meta = [("KEYVAL", (b"nation", ("INT", nation))), ("KEYVAL", (b"customers", ("UINT", len(customers)))), ("KEYVAL", (b"nation", ("INT", -1)))]
    data = bpk.encode([{"type": "DATA", "id": nation + 10, "records": groups}, {"type": "METADATA", "id": 7, "records": meta}, {"type": "STRINGS", "id": 7, "records": [("STRING", b"tail")]}], 0)
    return data[:-1] + b"?" if nation % 2 else data


def _bpk(spark, sf_dir, view):
    return formats.decode(encoded(_customers(spark, sf_dir), _container), "bpk", view)


_NODES = f"""
    with c as ({_CUSTOMERS}), n as (select c_nationkey, count(*) as n from customer group by c_nationkey),
    nodes as (
        select c_nationkey, 0 as section_idx, 9 * i as pre_order, null::bigint as parent_id, 0 as depth, 'GROUP' as tag, null::bigint as num, null::double as f64, null as text from c
        union all select c_nationkey, 0, 9 * i + 1, 9 * i, 1, 'UINT', c_custkey, null, null from c
        union all select c_nationkey, 0, 9 * i + 2, 9 * i, 1, 'STRING', null, null, c_name from c
        union all select c_nationkey, 0, 9 * i + 3, 9 * i, 1, 'FLOAT', null, c_acctbal, null from c
        union all select c_nationkey, 0, 9 * i + 4, 9 * i, 1, 'KEYVAL', null, null, 'segment' from c
        union all select c_nationkey, 0, 9 * i + 5, 9 * i + 4, 2, 'STRING', null, null, c_mktsegment from c
        union all select c_nationkey, 0, 9 * i + 6, 9 * i, 1, 'ARRAY', null, null, null from c
        union all select c_nationkey, 0, 9 * i + 7, 9 * i + 6, 2, 'INT', -c_custkey, null, null from c
        union all select c_nationkey, 0, 9 * i + 8, 9 * i + 6, 2, 'INT', c_custkey % 7, null, null from c
        union all select c_nationkey, 1, 9 * n, null, 0, 'KEYVAL', null, null, 'nation' from n
        union all select c_nationkey, 1, 9 * n + 1, 9 * n, 1, 'INT', c_nationkey, null, null from n
        union all select c_nationkey, 1, 9 * n + 2, null, 0, 'KEYVAL', null, null, 'customers' from n
        union all select c_nationkey, 1, 9 * n + 3, 9 * n + 2, 1, 'UINT', n, null, null from n
        union all select c_nationkey, 1, 9 * n + 4, null, 0, 'KEYVAL', null, null, 'nation' from n
        union all select c_nationkey, 1, 9 * n + 5, 9 * n + 4, 1, 'INT', -1, null, null from n
        union all select c_nationkey, 2, 9 * n + 6, null, 0, 'STRING', null, null, case when c_nationkey % 2 = 1 then 'tai?' else 'tail' end from n)"""


@query(_NODES + " select 'nation-' || c_nationkey as path, section_idx, pre_order, parent_id, depth, tag, num, f64, text from nodes")
def bpk_records(spark, sf_dir):
    nodes = _bpk(spark, sf_dir, "records")
    number, text = F.coalesce("i64", F.col("u64").cast("long")), F.coalesce("str", "key").cast("string")
    return nodes.select("path", "section_idx", "pre_order", "parent_id", "depth", "tag", number.alias("num"), "f64", text.alias("text"))


@query("""
    with n as (select c_nationkey, count(*) as n from customer group by c_nationkey)
    select 'nation-' || c_nationkey as path, k as section_idx, ['DATA', 'METADATA', 'STRINGS'][k + 1] as type, case when k = 0 then c_nationkey + 10 else 7 end as id,
        case k when 0 then n when 1 then 3 else 1 end as item_count, case k when 0 then n when 1 then 3 else 1 end as records, k < 2 or c_nationkey % 2 = 0 as crc_ok
    from n, (values (0), (1), (2)) s(k)""")
def bpk_sections(spark, sf_dir):
    return _bpk(spark, sf_dir, "sections").select("path", "section_idx", "type", "id", "item_count", "records", "crc_ok")


@query("select distinct 'nation-' || c_nationkey as path, 1 as version, 1 as flags, true as header_ok, c_nationkey % 2 = 0 as checksum_ok, 3 as sections from customer")
def bpk_containers(spark, sf_dir):
    return _bpk(spark, sf_dir, "containers").select("path", "version", "flags", "header_ok", "checksum_ok", "sections")


@query("select 'nation-' || c_nationkey as path, c_nationkey::bigint as nation, null::bigint as as_uint, count(*) as customers from customer group by c_nationkey")
def bpk_metadata(spark, sf_dir):
    """The first entry of a key, typed without conversion."""
    entries = _bpk(spark, sf_dir, "metadata")
    nation = tree.metadata_value(entries, b"nation").select("path", tree.typed("INT").alias("nation"), tree.typed("UINT").cast("long").alias("as_uint"))
    return nation.join(tree.metadata_value(entries, b"customers").select("path", tree.typed("UINT").cast("long").alias("customers")), "path")


@query("""
    with p as (select distinct 'nation-' || c_nationkey as path from customer)
    select path, 'by type' as how, 0 as section_idx from p union all select path, 'by id', 1 from p union all select path, 'all', 2 from p""")
def bpk_find_sections(spark, sf_dir):
    sections = _bpk(spark, sf_dir, "sections")
    found = lambda rows, how: rows.select("path", F.lit(how).alias("how"), "section_idx")
    return found(tree.find_section(sections, "DATA"), "by type").unionByName(found(tree.find_section(sections, ident=7), "by id")).unionByName(found(tree.find_sections(sections, "STRINGS"), "all"))


@query("select 'nation-' || c_nationkey as path, unnest([-c_custkey, c_custkey % 7]) as i64 from customer")
def bpk_collect(spark, sf_dir):
    return tree.collect_records(_bpk(spark, sf_dir, "records"), "INT", section=0).select("path", "i64")


@query("select 'nation-' || c_nationkey as path, count(*) as groups, count(*) as arrays, count(*) + 3 as keyvals, 6 * count(*) + 4 as scalars, 2 as max_depth from customer group by c_nationkey")
def bpk_shape(spark, sf_dir):
    return tree.tree_stats(_bpk(spark, sf_dir, "records"))


class _Bytes(bpk.Visitor):
    """Bytes of strings by depth, and how often each kind of node is entered and left."""

    def __init__(self):
        self.open = 0

    def visit_scalar(self, node):
        if node.tag == "STRING":
            yield node.section, node.depth, len(node.str), self.open

    def enter(self, node):
        self.open += 1

    def leave(self, node):
        self.open -= 1


@query(_NODES + " select 'nation-' || c_nationkey as path, section_idx, depth, count(*) as n, sum(length(text))::bigint as bytes, bool_and(true) as balanced from nodes where tag = 'STRING' group by all")
def bpk_visit(spark, sf_dir):
    """A user's hooks over every container."""
    seen = formats.visit(encoded(_customers(spark, sf_dir), _container), _Bytes, "section_idx int, depth int, bytes bigint, open int")
    return seen.groupBy("path", "section_idx", "depth").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.every(F.col("open") == F.col("depth")).alias("balanced"))


@query("select distinct 'nation-' || c_nationkey as path, true as same from customer where c_nationkey % 2 = 0")
def bpk_rewrite(spark, sf_dir):
    """Decoded tables encode to the bytes they came from."""
    files = encoded(_customers(spark, sf_dir).where("items[0].c_nationkey % 2 = 0"), _container)
    nodes, sections = (formats.decode(files, "bpk", v).where("error is null") for v in ("records", "sections"))
    again = sinks.bpk_containers(nodes, sections).withColumnRenamed("content", "again")
    return files.join(again, "path").select("path", (F.col("content") == F.col("again")).alias("same"))


def _faulty(path, regions):
    k = regions[0]["n_nationkey"]
    records = [("UINT", 1), ("UINT", 2)] + [("GROUP", [])] * (k % 4 == 0) + [("ARRAY", [])] * (k % 3 == 0) + [("BLOB", bytes(64))] * (k % 5 == 0)
    meta = [("KEYVAL", (b"k", ("UINT", 1)))] * (2 if k % 2 else 1) + [("KEYVAL", (b"", ("UINT", 1)))] * (k % 7 == 0)
    return bpk.encode([{"type": "DATA", "records": records, "item_count": len(records) + (k % 6 == 0)}, {"type": "METADATA", "records": meta}])


@query("""
    with x as (select n_nationkey as k, (k % 4 = 0)::bigint + (k % 3 = 0)::bigint + (k % 5 = 0)::bigint + (k % 7 = 0)::bigint as warnings, (k % 6 = 0)::bigint + (k % 2 = 1)::bigint as errors from nation)
    select k::varchar as path, errors, warnings, errors = 0 as ok from x""")
def bpk_report(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), "n_nationkey"), _faulty)
    return tree.report(files, formats.decode(files, "bpk", "issues", max_blob=16))


@query("select n_nationkey::varchar as path, 0 as section_idx, (2 + (k % 4 = 0)::bigint + (k % 3 = 0)::bigint + (k % 5 = 0)::bigint) as records from (select *, n_nationkey as k from nation) where k % 6 = 0")
def bpk_item_counts(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), "n_nationkey"), _faulty)
    return tree.item_count_mismatches(formats.decode(files, "bpk", "sections")).select("path", "section_idx", "records")


def _region(path, regions):
    r = regions[0]
    return bpk.encode([{"type": "DATA", "id": r["r_regionkey"], "records": [("UINT", r["r_regionkey"]), ("STRING", r["r_name"].encode()), ("FLOAT", r["r_regionkey"] / 2)]}], bpk.HAS_TRAILER)


@query(r"""
    select r_name as path, 'BPK1 container' || e'\n  version       : 1\n  flags         : 0x0002 has_trailer_crc\n  checksum_ok   : true\n  header_crc_ok : true\n  trailer_crc_ok: true\n  sections      : 1\n\n'
        || 'section[0] DATA id=' || r_regionkey || ' flags=0x0000 item_count=3 records=3 body_crc_ok=true' || e'\n  - UINT: ' || r_regionkey || e'\n  - STRING: "' || r_name || e'"\n  - FLOAT: ' || printf('%g', r_regionkey / 2) || e'\n' as summary
    from region""")
def bpk_summary(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "region"), F.col("r_name"), "r_regionkey", "r_name"), _region)
    return formats.decode(files, "bpk", "containers").select("path", "summary")


@query("select n_nationkey::varchar as path, case n_nationkey % 3 when 0 then 'BadMagic' when 1 then 'ShortRead' else 'BadVersion' end as code from nation")
def bpk_errors(spark, sf_dir):
    """Damaged files are rows with an error, not failures."""

    def damaged(path, items):
        data, k = bpk.encode([{"type": "DATA", "records": [("UINT", 1)]}]), int(path) % 3
        return b"XXXX" + data[4:] if k == 0 else data[:2] if k == 1 else data[:4] + b"\x09" + data[5:]

    files = encoded(_items(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), "n_nationkey"), damaged)
    return formats.decode(files, "bpk", "records").select("path", "error.code")


# -- page stores -------------------------------------------------------------------------------

#: Records on a page, and entries on an index page.
_SLOTS, _ENTRIES = 20, 50


def _record(c, segments, more=0):
    return mdb.encode_record([("INT", -c["c_custkey"]), ("STRING_REF", segments.index(c["c_mktsegment"]) if c["c_custkey"] % 13 else 99), ("FLOAT", c["c_acctbal"] + more), ("INLINE_STRING", c["c_name"].encode()), ("BOOL", c["c_custkey"] % 2), ("NULL", None), ("BLOB", bytes(c["c_custkey"] % 4)), ("UINT", c["c_custkey"])])


def _store(path, customers):
    """A store of a nation: strings, data pages, index pages by name, an overflow chain, and a journal that changes some records."""
    segments = sorted({c["c_mktsegment"] for c in customers})
    place = {c["c_custkey"]: (1 + i // _SLOTS, i % _SLOTS) for i, c in enumerate(customers)}
    data = [mdb.encode_page("DATA", 4096, [_record(c, segments) for c in customers[i : i + _SLOTS]]) for i in range(0, len(customers), _SLOTS)]
    entries = [(c["c_name"].encode(), *place[c["c_custkey"]]) for c in reversed(customers)]
    index = [mdb.encode_page("INDEX", 4096, body=mdb.encode_index(entries[i : i + _ENTRIES])) for i in range(0, len(entries), _ENTRIES)]
    at = 1 + len(data) + len(index)
    chain = [mdb.encode_page("OVERFLOW", 4096, body=f"{path}/{k};".encode(), overflow_next=(at + k + 1, at + k + 1, mdb.NO_NEXT, at + 4, at + 3, 9999)[k]) for k in range(6)]
    pages = [mdb.encode_page("STRINGS", 4096, body=mdb.encode_strings([s.encode() for s in segments])), *data, *index, *chain]
    of = lambda n: [c for c in customers if c["c_custkey"] % n == 0]
    ops = [("UPDATE", *place[c["c_custkey"]], _record(c, segments, 1000)) for c in of(5)]
    ops += [("BEGIN",), *[("DELETE", *place[c["c_custkey"]]) for c in of(7)], ("COMMIT",), ("BEGIN",), *[("DELETE", *place[c["c_custkey"]]) for c in of(11)], ("ROLLBACK",)]
    ops += [("BEGIN",), *[("DELETE", *place[c["c_custkey"]]) for c in of(3)], ("BEGIN",), *[("DELETE", *place[c["c_custkey"]]) for c in of(2)]]
    return mdb.encode(4096, pages, string_page=0, journal_=mdb.encode_journal(ops))


def _stores(spark, sf_dir):
    return encoded(_customers(spark, sf_dir), _store)


_LIVE = f"""
    with c as ({_CUSTOMERS}),
    live as (select *, 'nation-' || c_nationkey as path, 1 + i // {_SLOTS} as page, (i % {_SLOTS})::int as slot, c_acctbal + case when c_custkey % 5 = 0 then 1000 else 0 end as balance from c where c_custkey % 7 <> 0)"""


@query(_LIVE + " select path, page, slot, -c_custkey as number, case when c_custkey % 13 <> 0 then c_mktsegment end as segment, c_custkey % 13 <> 0 as resolved, balance, c_name as name, null::bigint as beyond from live")
def mdb_live(spark, sf_dir):
    """Records after journal replay, with references resolved."""
    at = lambda i: tree.field("fields", i)
    return formats.mdb_records(_stores(spark, sf_dir)).select(
        "path", "page", "slot", at(0)["i64"].alias("number"), at(1)["str"].cast("string").alias("segment"), at(1)["ref_resolved"].alias("resolved"),
        at(2)["f64"].alias("balance"), at(3)["str"].cast("string").alias("name"), at(8)["i64"].alias("beyond"),
    )


@query(_LIVE + """
    select path, page, slot, concat_ws('|', -c_custkey, case when c_custkey % 13 = 0 then '#99' else c_mktsegment end, printf('%g', balance), c_name, case when c_custkey % 2 = 1 then 'true' else 'false' end, 'null', 'blob[' || c_custkey % 4 || ']', c_custkey) as row from live""")
def mdb_rows(spark, sf_dir):
    return tree.project_row(formats.mdb_records(_stores(spark, sf_dir))).select("path", "page", "slot", F.array_join("values", "|").alias("row"))


@query("""
    select 'nation-' || c_nationkey as path, count(*) filter (c_custkey % 5 = 0) + count(*) filter (c_custkey % 7 = 0) as committed_ops,
        count(*) filter (c_custkey % 11 = 0) + count(*) filter (c_custkey % 2 = 0) as rolled_back_ops from customer group by c_nationkey""")
def mdb_ops(spark, sf_dir):
    """A BEGIN inside a transaction drops what was staged without counting it; the journal's end undoes the rest."""
    return formats.mdb_counts(_stores(spark, sf_dir))


_PAGES = f"""
    with n as (select c_nationkey, count(*) as n, count(distinct c_mktsegment) as s from customer group by c_nationkey),
    p as (select *, 'nation-' || c_nationkey as path, (n + {_SLOTS - 1}) // {_SLOTS} as data, (n + {_ENTRIES - 1}) // {_ENTRIES} as idx from n)"""


@query(_PAGES + """
    select path, unnest(['FREE', 'DATA', 'STRINGS', 'INDEX', 'OVERFLOW']) as type, unnest([0, data, 1, idx, 6]) as n from p""")
def mdb_page_types(spark, sf_dir):
    return formats.mdb_catalog(_stores(spark, sf_dir))


@query(_PAGES + """
    , live as (select c_nationkey, count(*) filter (c_custkey % 7 <> 0) as live_records from customer group by c_nationkey),
    seg as (select c_nationkey, sum(length(c_mktsegment))::bigint as string_bytes from (select distinct c_nationkey, c_mktsegment from customer) group by c_nationkey)
    select path, 1 + data + idx + 6 as pages, live_records, n as used_slots, 0::bigint as dead_slots, s as strings, string_bytes from p join live using (c_nationkey) join seg using (c_nationkey)""")
def mdb_totals(spark, sf_dir):
    return formats.mdb_totals(_stores(spark, sf_dir))


@query(f"""
    with c as ({_CUSTOMERS}) select 'nation-' || c_nationkey as path, c_name as name, 1 + i // {_SLOTS} as page, (i % {_SLOTS})::int as slot, case when c_custkey % 7 <> 0 then c_custkey end as custkey
    from c where c_name between 'Customer#000000010' and 'Customer#000000500'""")
def mdb_index_records(spark, sf_dir):
    """A range of index entries joined by their locators; deleted records are missing."""
    files = _stores(spark, sf_dir)
    key = lambda s: F.lit(bytearray(s))
    entries = lookup.key_range(formats.decode(files, "mdb", "index"), "key", key(b"Customer#000000010"), key(b"Customer#000000500")).select("path", F.col("key").cast("string").alias("name"), "page", "slot")
    live = formats.mdb_records(files).select("path", "page", "slot", tree.field("fields", 7)["u64"].cast("long").alias("custkey"))
    return entries.join(live, ["path", "page", "slot"], "left").select("path", "name", "page", "slot", "custkey")


@query(f"""
    with c as (select *, row_number() over (partition by c_nationkey order by c_custkey desc) - 1 as j from customer),
    p as (select *, j // {_ENTRIES} as part from c)
    select 'nation-' || c_nationkey as path, part, row_number() over (partition by c_nationkey, part order by c_name) - 1 as ordinal, c_name as name from p""")
def mdb_index_order(spark, sf_dir):
    """Entries come sorted by key on each page."""
    entries = formats.decode(_stores(spark, sf_dir), "mdb", "index")
    first = entries.groupBy("path").agg(F.min("page_index").alias("first"))
    return entries.join(first, "path").select("path", (F.col("page_index") - F.col("first")).alias("part"), F.col("ordinal").cast("long").alias("ordinal"), F.col("key").cast("string").alias("name"))


@query(_PAGES + """
    , s as (select path, 1 + data + idx as at from p)
    select path, k as nth, case when k < 3 then 'COMPLETE' when k < 5 then 'CYCLE' else 'DANGLING_PAGE' end as status,
        case k when 0 then path || '/0;' || path || '/1;' || path || '/2;' when 1 then path || '/1;' || path || '/2;' when 2 then path || '/2;' when 3 then path || '/3;' || path || '/4;'
            when 4 then path || '/4;' || path || '/3;' else path || '/5;' end as text,
        [3, 2, 1, 2, 2, 1][k + 1] as visited from s, (select unnest(range(6)) as k)""")
def mdb_overflow(spark, sf_dir):
    chains = formats.decode(_stores(spark, sf_dir), "mdb", "overflow")
    first = chains.groupBy("path").agg(F.min("start").alias("first"))
    return chains.join(first, "path").select("path", (F.col("start") - F.col("first")).alias("nth"), "status", F.col("bytes").cast("string").alias("text"), F.size("visited").alias("visited"))


@query("""
    select distinct 'nation-' || c_nationkey as path, k as nth, ['PAGE_LIMIT', 'COMPLETE', 'COMPLETE', 'CYCLE', 'CYCLE', 'DANGLING_PAGE'][k + 1] as by_pages, ['LENGTH_LIMIT', 'LENGTH_LIMIT', 'COMPLETE', 'LENGTH_LIMIT', 'LENGTH_LIMIT', 'DANGLING_PAGE'][k + 1] as by_bytes
    from customer, (select unnest(range(6)) as k)""")
def mdb_overflow_caps(spark, sf_dir):
    """Chains longer than a number of pages, or of bytes, end with what was read until then."""
    files = _stores(spark, sf_dir)
    pages, size = formats.decode(files, "mdb", "overflow", max_pages=2), formats.decode(files, "mdb", "overflow", max_bytes=15)
    first = pages.groupBy("path").agg(F.min("start").alias("first"))
    both = pages.select("path", "start", F.col("status").alias("by_pages")).join(size.select("path", "start", F.col("status").alias("by_bytes")), ["path", "start"])
    return both.join(first, "path").select("path", (F.col("start") - F.col("first")).alias("nth"), "by_pages", "by_bytes")


@query(f"with c as ({_CUSTOMERS}) select 'nation-' || c_nationkey as path, 1 + i // {_SLOTS} as page, count(*) as used, 0::bigint as dead from c group by all")
def mdb_slot_use(spark, sf_dir):
    return formats.mdb_slot_use(_stores(spark, sf_dir))


@query(f"with c as ({_CUSTOMERS}) select 'nation-' || c_nationkey as path, 1 + i // {_SLOTS} as page, (i % {_SLOTS})::int as slot, c_name as name from c where c_custkey % 7 <> 0 qualify row_number() over (partition by path order by page, slot) <= 5")
def mdb_cursor(spark, sf_dir):
    """The first five records of each store from the beginning on, in key order."""
    from pyspark.sql import Window

    live = formats.mdb_records(_stores(spark, sf_dir)).select("path", "page", "slot", tree.field("fields", 3)["str"].cast("string").alias("name"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("page", "slot"))
    return live.withColumn("rank", rank).where("rank <= 5").drop("rank")


def _tiny(path, nations):
    names = [n["n_name"].encode() for n in nations]
    rows = [mdb.encode_record([("STRING_REF", i), ("UINT", n["n_nationkey"]), ("FLOAT", n["n_nationkey"] / 2)]) for i, n in enumerate(nations)]
    ops = [("INSERT", 1, 7, mdb.encode_record([("INT", -5), ("STRING_REF", 77), ("INLINE_STRING", b'a"\n'), ("BLOB", b"xyz"), ("NULL", None), ("BOOL", True)])), ("BEGIN",), ("DELETE", 1, 0), ("ROLLBACK",)]
    return mdb.encode(1024, [mdb.encode_page("STRINGS", 1024, body=mdb.encode_strings(names)), mdb.encode_page("DATA", 1024, rows)], string_page=0, journal_=mdb.encode_journal(ops), flags=3)


def _tiny_stores(spark, sf_dir):
    return encoded(_items(table(spark, sf_dir, "nation"), F.col("n_regionkey").cast("string"), "n_nationkey", "n_name"), _tiny)


_NAMED = "with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation)"


@query(_NAMED + r"""
    select n_regionkey::varchar as path, e'minidb MDB1 store\n  version       : 1\n  page_size     : 1024\n  page_count    : 2\n  root_page     : 0\n  string_table  : page 0\n'
        || e'  journal       : offset 2080, 1 committed, 1 rolled back\n  flags         : 0x00000003\n  checksum_ok   : yes\n' || 'string table (' || count(*) || e' entries)\n'
        || string_agg('  [' || i || '] "' || n_name || e'"\n', '' order by i) || e'pages (2)\n  page 0: STRINGS, slots=0\n  page 1: DATA, slots=' || count(*) || e'\n' || 'committed records (' || count(*) + 1 || e')\n'
        || string_agg('  (page 1, slot ' || i || '): STRING_REF=#' || i || ' "' || n_name || '", UINT=' || n_nationkey || ', FLOAT=' || printf('%g', n_nationkey / 2) || e'\n', '' order by i)
        || e'  (page 1, slot 7): INT=-5, STRING_REF=#77 <unresolved>, INLINE_STRING="a"\\x0a", BLOB=blob[3], NULL=null, BOOL=true\n' as summary
    from n group by n_regionkey""")
def mdb_summary(spark, sf_dir):
    return formats.decode(_tiny_stores(spark, sf_dir), "mdb", "summaries").select("path", "summary")


@query(_NAMED + r"""
    select n_regionkey::varchar as path, e'minidb catalog\n  pages          : 2\n  page types     : DATA=1 STRINGS=1\n  live records   : ' || count(*) + 1 || e'\n  slots used/dead: ' || count(*) || e'/0\n  strings        : '
        || count(*) || ' entries, ' || sum(length(n_name))::bigint || ' bytes, max ' || max(length(n_name)) || e', 0 empty\n  per-page:\n    page 0: STRINGS, slots 0/0 used\n    page 1: DATA, slots ' || count(*) || '/' || count(*) || e' used\n' as catalog
    from n group by n_regionkey""")
def mdb_catalog_text(spark, sf_dir):
    return formats.decode(_tiny_stores(spark, sf_dir), "mdb", "summaries").select("path", "catalog")


# -- configuration -----------------------------------------------------------------------------


def _script(path, customers):
    """A script of a customer, with expressions, scopes, arrays, objects and blocks."""
    c = customers[0]
    k = c["c_custkey"]
    return f'''
        include "base.cfg"; # comment
        name = "{c["c_name"]}"; key = {k}; balance = {c["c_acctbal"]!r}; on = {"true" if k % 2 else "false"}; none = null;
        list = [key, key * 2, [key << 3]]; meta = {{ owner = name + "/" + key; tier = key % 3; }};
        server "main" {{ port = 8000 + key; deep {{ port = port + 1; label = port > 8100 ? "high" : "low"; }} }}
        server {{ port = 1; other = key ^ 255; }}
        a.b = -key; text = "q\\"\\n" + balance; wrap = 9223372036854775807 + key; /* end */
    '''.encode()


def _scripts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_acctbal is not null")
    return encoded(_items(rows, F.col("c_custkey").cast("string"), "c_custkey", "c_name", "c_acctbal"), _script)


_FLAT = r"""
    with v as (select *, c_custkey as k, c_custkey::varchar as s, format('{:.6f}', c_acctbal) as bal from customer where c_acctbal is not null),
    f as (
        select s as path, 0 as ordinal, 'include' as key, 'base.cfg' as value from v
        union all select s, 1, 'name', '"' || c_name || '"' from v
        union all select s, 2, 'key', s from v
        union all select s, 3, 'balance', bal from v
        union all select s, 4, 'on', case when k % 2 = 1 then 'true' else 'false' end from v
        union all select s, 5, 'none', 'null' from v
        union all select s, 6, 'list[0]', s from v
        union all select s, 7, 'list[1]', (k * 2)::varchar from v
        union all select s, 8, 'list[2][0]', (k * 8)::varchar from v
        union all select s, 9, 'meta.owner', '"' || c_name || '/' || s || '"' from v
        union all select s, 10, 'meta.tier', (k % 3)::varchar from v
        union all select s, 11, 'server[main].port', (8000 + k)::varchar from v
        union all select s, 12, 'server[main].deep.port', (8001 + k)::varchar from v
        union all select s, 13, 'server[main].deep.label', case when 8001 + k > 8100 then '"high"' else '"low"' end from v
        union all select s, 14, 'server.port', '1' from v
        union all select s, 15, 'server.other', xor(k, 255)::varchar from v
        union all select s, 16, 'a.b', (-k)::varchar from v
        union all select s, 17, 'text', e'"q\\"\\n' || bal || '"' from v
        union all select s, 18, 'wrap', ((9223372036854775807::hugeint + k + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::varchar from v)"""


@query(_FLAT + " select * from f")
def cfg_flat(spark, sf_dir):
    """Scripts evaluated and flattened."""
    return formats.decode(_scripts(spark, sf_dir), "cfg", "flat").select("path", "ordinal", "key", "value")


@query(r"""
    with v as (select c_custkey as k, c_acctbal from customer where c_acctbal is not null)
    select k::varchar as path, q as query, case q when 'balance' then 'float' when 'list[2]' then 'array' when 'meta.owner' then 'string' when 'on' then 'bool' when 'nope' then null when 'list[9]' then null else 'int' end as type,
        case q when 'server.deep.port' then 8001 + k when 'server.port' then 8000 + k when 'server.other' then xor(k, 255) when 'a.b' then -k when 'meta.tier' then k % 3 when 'balance' then trunc(c_acctbal)::bigint end as as_int,
        case q when 'server.deep.port' then 8001 + k when 'server.port' then 8000 + k when 'server.other' then xor(k, 255) when 'a.b' then -k when 'meta.tier' then k % 3 when 'balance' then c_acctbal end::double as as_float,
        case q when 'on' then k % 2 = 1 end as as_bool, case q when 'list[2]' then '[' || k * 8 || ']' end as list
    from v, (select unnest(['server.deep.port', 'server.port', 'server.other', 'a.b', 'meta.tier', 'balance', 'list[2]', 'meta.owner', 'on', 'nope', 'list[9]']) as q)""")
def cfg_query(spark, sf_dir):
    paths = ["server.deep.port", "server.port", "server.other", "a.b", "meta.tier", "balance", "list[2]", "meta.owner", "on", "nope", "list[9]"]
    found = formats.decode(_scripts(spark, sf_dir), "cfg", "query", paths=paths)
    return found.select("path", "query", "type", "as_int", "as_float", "as_bool", F.when(F.col("type") == "array", F.col("text")).alias("list"))


@query("""
    with v as (select c_custkey as k, c_acctbal, c_name from customer where c_acctbal is not null)
    select k::varchar as path, 'missing-required' as kind, 'owner' as rule from v union all select k::varchar, 'type-mismatch', 'name' from v
    union all select k::varchar, 'above-maximum', 'server.port' from v where 8000 + k > 8100 union all select k::varchar, 'below-minimum', 'balance' from v where c_acctbal < 0
    union all select k::varchar, 'not-allowed', 'server.deep.label' from v where 8001 + k <= 8100""")
def cfg_violations(spark, sf_dir):
    rules = [cfg.Rule("owner", "string", required=True), cfg.Rule("name", "int"), cfg.Rule("server.port", "float", high=8100), cfg.Rule("balance", "float", low=0), cfg.Rule("server.deep.label", "string", allowed=(b"high",)), cfg.Rule("nothing", "int")]
    return formats.decode(_scripts(spark, sf_dir), "cfg", "violations", rules=rules).select("path", "kind", "rule")


@query(r"""
    with v as (select *, c_custkey as k, format('{:.6f}', c_acctbal) as bal from customer where c_acctbal is not null)
    select k::varchar as path, 13 as nodes, e'include "base.cfg";\nname = "' || c_name || e'";\nkey = ' || k || e';\nbalance = ' || bal || e';\non = ' || case when k % 2 = 1 then 'true' else 'false' end || e';\nnone = null;\nlist = [' || k || ', ' || k * 2 || ', [' || k * 8 || e']];\n'
        || 'meta = { owner = "' || c_name || '/' || k || '"; tier = ' || k % 3 || e'; };\nserver "main" {\n  port = ' || 8000 + k || e';\n  deep {\n    port = ' || 8001 + k || e';\n    label = "' || case when 8001 + k > 8100 then 'high' else 'low' end
        || e'";\n  }\n}\nserver {\n  port = 1;\n  other = ' || xor(k, 255) || e';\n}\na.b = ' || -k || e';\ntext = "q\\"\\n' || bal || e'";\nwrap = ' || ((9223372036854775807::hugeint + k + 9223372036854775808) % 18446744073709551616 - 9223372036854775808) || e';\n' as canonical, case when k <> 1 then true end as same
    from v""")
def cfg_canonical(spark, sf_dir):
    """Canonical text, which parses to the same canonical text; only the lowest integer (customer 1) has no literal."""
    done = formats.decode(_scripts(spark, sf_dir), "cfg", "documents").where("error is null").select("path", "nodes", "canonical")
    again = formats.decode(done.select("path", F.col("canonical").cast("binary").alias("content")), "cfg", "documents").select("path", F.col("canonical").alias("again"))
    return done.join(again, "path").select("path", "nodes", "canonical", (F.col("canonical") == F.col("again")).alias("same"))


@query("""
    with v as (select c_custkey::varchar as path from customer where c_acctbal is not null),
    n as (select unnest(['include', 'name', 'key', 'balance', 'on', 'none', 'list', 'meta', 'server', 'port', 'deep', 'port', 'label', 'server', 'port', 'other', 'b', 'text', 'wrap']) as leaf, unnest(range(19)) as node_id,
        unnest([null, null, null, null, null, null, null, null, null, 8, 8, 10, 10, null, 13, 13, null, null, null]) as parent_id)
    select path, node_id, parent_id::bigint as parent_id, case when leaf = 'include' then 'include' when leaf in ('server', 'deep') then 'block' else 'assignment' end as kind, case when leaf in ('server', 'deep') then leaf end as name,
        case when node_id = 8 then 'main' end as label, case when leaf not in ('include', 'server', 'deep') then leaf end as leaf from v, n""")
def cfg_nodes(spark, sf_dir):
    nodes = formats.decode(_scripts(spark, sf_dir), "cfg", "nodes")
    return nodes.select("path", "node_id", "parent_id", "kind", "name", F.col("label").cast("string").alias("label"), F.element_at("assign_path", -1).alias("leaf"))


@query("""
    select c_custkey::varchar as path, unnest(['name', 'op', 'float', 'op', 'int', 'op', 'str', 'op', 'name', 'op', 'end']) as kind, unnest(range(11))::int as ordinal,
        unnest(['identifier', '''=''', 'float', '''+''', 'integer', '''+''', 'string', '''+''', '''null''', ''';''', 'end of input']) as name,
        unnest(['x', '=', '1.5', '+', c_custkey::varchar, '+', '"a\\x0b"', '+', 'null', ';', '']) as text from customer""")
def cfg_tokens(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), "c_custkey"), lambda path, items: f'x = 1.5/*.*/+ {int(path):#x} + "a\\x0b" + null; // end'.encode())
    return formats.decode(files, "cfg", "tokens").select("path", "kind", "ordinal", "name", "text")


@query("""
    with v as (select c_custkey as k from customer)
    select k::varchar as path, case k % 6 when 0 then 'StateViolation' when 1 then 'BadType' when 2 then 'StateViolation' when 3 then 'BadType' when 4 then 'BadLength' else 'DepthExceeded' end as code from v""")
def cfg_errors(spark, sf_dir):
    """What the language refuses: division by zero, bad types, wide shifts, open strings, large numbers, deep nesting."""
    bad = ["x = 1 / 0;", 'x = 1 - "a";', "x = 1 << 64;", 'x = "open', "x = 99999999999999999999;", "x = " + "(" * 100 + "1" + ")" * 100 + ";"]
    files = encoded(_items(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), "c_custkey"), lambda path, items: bad[int(path) % 6].encode())
    return formats.decode(files, "cfg", "flat").select("path", "error.code")


@query("""
    select c_custkey::varchar as path, 'StateViolation' as code, 4 + length(c_custkey::varchar) + 1 as "offset", '[operation invalid in current state @ ' || 5 + length(c_custkey::varchar) || '] division by zero' as message from customer""")
def cfg_error_places(spark, sf_dir):
    """Errors say where they are, counted from the start of the file."""
    files = encoded(_items(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), "c_custkey"), lambda path, items: f"x = {path} / 0;".encode())
    return formats.decode(files, "cfg", "flat").select("path", "error.code", "error.offset", "error.message")


@query("""
    with v as (select c_custkey as k from customer)
    select kind, key, old, new from (
        select 0 as phase, k, 'REMOVED' as kind, 'gone' || k as key, k::varchar as old, null as new from v
        union all select 1, k, 'CHANGED', 'twice' || k, '2', '3' from v union all select 1, k, 'ADDED', 'fresh' || k, null, (k + 1)::varchar from v)""")
def cfg_changes(spark, sf_dir):
    """Differences of two scripts; of repeated paths the last one counts."""
    keys = _items(table(spark, sf_dir, "customer"), F.lit("all"), "c_custkey")
    before = encoded(keys, lambda path, items: "".join(f"twice{k} = 1; gone{k} = {k}; twice{k} = 2; same{k} = 5;" for k in (c["c_custkey"] for c in items)).encode())
    after = encoded(keys, lambda path, items: "".join(f"same{k} = 5; twice{k} = 3; fresh{k} = {k} + 1;" for k in (c["c_custkey"] for c in items)).encode())
    flat = lambda files: formats.decode(files, "cfg", "flat").select("key", "value", "ordinal")
    return config.diff(flat(before), flat(after), "key", "value", "ordinal").select("kind", "key", "old", "new")


@query(r"""
    select r_name as path, 'cfgscript document: 2 top-level nodes' || e'\na = [1, ' || r_regionkey || e', {x = "y"}]\nb "l" {\n  c = 0.500000\n}\n' as summary from region""")
def cfg_summary(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "region"), F.col("r_name"), "r_regionkey"), lambda path, items: f'a = [1, {items[0]["r_regionkey"]}, {{ x = "y"; }}]; b "l" {{ c = 0.5; }}'.encode())
    return formats.decode(files, "cfg", "documents").select("path", "summary")


# -- framed streams ----------------------------------------------------------------------------

_PIECE, _STREAMS = 1000, 8


def _frame_files(spark, sf_dir):
    """Every document as a message, its fragments out of order, on one of a few streams; a file for each stream."""
    messages = table(spark, sf_dir, "documents").select((F.col("doc_id") % _STREAMS).cast("int").alias("stream_id"), F.col("doc_id").alias("msg_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), (F.col("doc_id") % 70_000 % 65_536).cast("int").alias("first_seq"), (F.col("doc_id") % 2 == 0).alias("compressed"))
    pieces = sinks.message_frames(messages, _PIECE, with_crc=True).withColumn("at", F.xxhash64("msg_id", "frag_idx"))
    items = _items(pieces, F.col("stream_id").cast("string"), "msg_id", "at", "content")
    return encoded(items, lambda path, items: b"".join(i["content"] for i in items))


_FRAGMENTS = f"""
    with d as (select doc_id, strlen(coalesce(text, '')) as n, (doc_id % {_STREAMS})::varchar as path, greatest(1, (strlen(coalesce(text, '')) + {_PIECE - 1}) // {_PIECE}) as pieces from documents),
    f as (select *, unnest(range(pieces)) as k from d)"""


@query(_FRAGMENTS + f"""
    select path, doc_id as msg_id, k * {_PIECE} as frag_offset, (doc_id % 70000 % 65536 + k) % 65536 as seq, least({_PIECE}, n - k * {_PIECE}) as size,
        8 + case when k = pieces - 1 then 1 else 0 end + case when pieces > 1 then 2 else 0 end + case when doc_id % 2 = 0 then 4 else 0 end as flags, true as crc_ok, 'DATA' as type from f""")
def sframe_frames(spark, sf_dir):
    found = formats.decode(_frame_files(spark, sf_dir), "sframe", "frames")
    return found.select("path", "msg_id", "frag_offset", F.col("seq").cast("long").alias("seq"), F.octet_length("payload").cast("long").alias("size"), "flags", "crc_ok", "type")


_WHOLE = f"select (doc_id % {_STREAMS})::varchar as path, (doc_id % {_STREAMS})::int as stream_id, doc_id as msg_id, doc_id % 2 = 0 as compressed, coalesce(text, '') as text from documents"


def _messages(found, fold=None):
    from tessera.streaming.folds import fold_batch

    done = (fold or fold_batch)(found, ["path", "stream_id"], "frame_idx", folds.ReassemblyFold, "path string, stream_id int")
    return done.select("path", "stream_id", "msg_id", "compressed", F.col("data").cast("string").alias("text"))


@query(_WHOLE)
def sframe_messages(spark, sf_dir):
    """Messages put together from fragments that come out of order."""
    return _messages(formats.decode(_frame_files(spark, sf_dir), "sframe", "frames"))


@query(_WHOLE)
def stream_messages(spark, sf_dir):
    """sframe_messages through Structured Streaming: files arrive, are decoded and reassembled with state for each stream."""
    from tessera.streaming.folds import drain, fold_stream

    from .queries import _folder

    folder = _folder(spark, "frames")
    files = _frame_files(spark, sf_dir)
    files.write.parquet(f"{folder}/in")
    live = formats.decode(spark.readStream.schema(files.schema).parquet(f"{folder}/in"), "sframe", "frames")
    return _messages(live, lambda *a: drain(fold_stream(*a), folder))


def _event_files(spark, sf_dir):
    """Frames of all kinds: events by user, with resets, acknowledgements, window updates and some wrong checksums."""

    def build(path, items):
        out = bytearray()
        for e in items:
            k, kind = e["event_id"], {"signup": "CONTROL", "click": "ACK", "error": "RESET"}.get(e["event_type"], "DATA")
            payload = k.to_bytes(4, "big") + (k % 1000).to_bytes(4, "big") if kind == "CONTROL" else b"x" * (k % 5) if kind == "DATA" else b""
            # Every third message of DATA begins and never ends.
            frame = frames.encode_frame(kind, int(path), k, k // 64 % 65536, payload, (frames.FRAG if k % 3 == 0 else frames.FIN) if kind == "DATA" else 0, with_crc=k % 4 == 0)
            # A wrong checksum is the right one inverted; fixed bytes would be right for one header in 65,536.
            out += frame if k % 8 else frame[:19] + bytes(b ^ 0xFF for b in frame[19:21]) + frame[21:]
        return bytes(out)

    rows = table(spark, sf_dir, "events").withColumn("stream", F.pmod("user_id", F.lit(50)))
    return encoded(_items(rows, F.col("stream").cast("string"), "event_id", "event_type"), build)


_SENT = "with e as (select *, (user_id % 50)::varchar as path, case event_type when 'signup' then 'CONTROL' when 'click' then 'ACK' when 'error' then 'RESET' else 'DATA' end as type from events)"


@query(_SENT + """
    select path, count(*) as frames, count(*) filter (type = 'CONTROL') as control, count(*) filter (type = 'ACK') as acks, count(*) filter (type = 'RESET') as resets,
        count(*) filter (event_id % 4 = 0 and event_id % 8 <> 0) as crc_ok, count(*) filter (event_id % 8 = 0) as crc_bad from e group by path""")
def sframe_counters(spark, sf_dir):
    return sequences.decode_counters(formats.decode(_event_files(spark, sf_dir), "sframe", "frames"), ["path"])


@query(_SENT + " select path, event_id as msg_id, type, case when type = 'CONTROL' then event_id end as ref_msg_id, case when type = 'CONTROL' then event_id % 1000 end as \"window\" from e where type in ('CONTROL', 'ACK')")
def sframe_controls(spark, sf_dir):
    found = formats.decode(_event_files(spark, sf_dir), "sframe", "frames").where("type in ('CONTROL', 'ACK')")
    return found.select("path", "msg_id", "type", "ref_msg_id", "window")


@query(_SENT + """
    , m as (select *, (event_id // 64) % 65536 as seq, coalesce(sum((type = 'RESET')::int) over (partition by path order by event_id rows between unbounded preceding and 1 preceding), 0) as epoch from e),
    l as (select *, lag(seq) over (partition by path, epoch order by event_id) as prev from m)
    select path, count(*) as frames, count(*) filter (seq <> prev and seq <> (prev + 1) % 65536) as gaps, count(*) filter (seq = prev) as dups, count(*) filter (type = 'RESET') as resets from l group by path""")
def sframe_stats(spark, sf_dir):
    found = formats.decode(_event_files(spark, sf_dir), "sframe", "frames")
    return sequences.stream_stats(sequences.observe(found, ["path"], "frame_idx", "seq", F.col("type") == "RESET"), ["path"])


@query(_SENT + """
    , m as (select *, coalesce(sum((type = 'RESET')::int) over (partition by path order by event_id rows between unbounded preceding and 1 preceding), 0) as epoch from e),
    o as (select *, count(*) filter (type = 'DATA' and event_id % 3 = 0) over (partition by path, epoch order by event_id rows unbounded preceding) as opened from m)
    select path, event_id as msg_id, (type = 'DATA' and event_id % 3 <> 0)::bigint as completed, case when type = 'RESET' then 0 else opened end as in_flight, case when type = 'RESET' then opened else 0 end as dropped from o""")
def sframe_in_flight(spark, sf_dir):
    """What is in flight after each frame, and what a RESET throws away."""
    from tessera.streaming.folds import fold_batch

    found = formats.decode(_event_files(spark, sf_dir), "sframe", "frames")
    state = fold_batch(found, ["path", "stream_id"], "frame_idx", folds.FlightFold, "path string, stream_id int")
    return found.select("path", "frame_idx", "msg_id").join(state, ["path", "frame_idx"]).select("path", "msg_id", "completed", "in_flight", "dropped")


def _greeting(path, nations):
    parts = [f for n in nations for f in frames.encode_message(3, n["n_nationkey"], n["n_name"].encode(), 4, n["n_nationkey"] * 10)]
    return b"".join([*parts, frames.encode_frame("CONTROL", 4, 0, 0, (42).to_bytes(4, "big") + (1024).to_bytes(4, "big")), frames.encode_frame("ACK", 4, 77, 1, with_crc=True), frames.encode_frame("RESET", 4, 0, 9)])


@query(r"""
    with n as (select *, n_nationkey as k, (length(n_name) + 3) // 4 as frames, row_number() over (partition by n_regionkey order by n_nationkey) as i, lag(n_nationkey * 10 + (length(n_name) + 3) // 4 - 1) over (partition by n_regionkey order by n_nationkey) as prev from nation)
    select n_regionkey::varchar as path, e'streamcodec decode\n  frames seen      : ' || sum(frames)::bigint + 3 || e'\n  messages emitted : ' || count(*) || e'\n  control frames   : 1\n  ack frames       : 1\n  reset frames     : 1\n  header crc ok    : 1\n  header crc bad   : 0\nmessages:\n'
        || string_agg('  stream 3 msg ' || k || ' size ' || length(n_name) || e'\n    bytes: ' || array_to_string(list_transform(string_split(substr(n_name, 1, 16), ''), lambda c: '0x' || lower(hex(c))), ' ') || case when length(n_name) > 16 then ' ...' else '' end || e'\n', '' order by k)
        || e'streams:\n  id 3 frames=' || sum(frames)::bigint || ' gaps=' || count(*) filter (k * 10 <> prev + 1 and k * 10 <> prev) || ' dups=' || count(*) filter (k * 10 = prev) || e' resets=0\n  id 4 frames=3 gaps=1 dups=0 resets=1\ncontrols:\n  stream 4 ref_msg=42 window=1024\nacks:\n  stream 4 msg 77\n' as summary
    from n group by n_regionkey""")
def sframe_summary(spark, sf_dir):
    files = encoded(_items(table(spark, sf_dir, "nation"), F.col("n_regionkey").cast("string"), "n_nationkey", "n_name"), _greeting)
    return formats.decode(files, "sframe", "summaries").select("path", "summary")


@query("select n_nationkey::varchar as path, case n_nationkey % 4 when 0 then 'BadMagic' when 1 then 'ShortRead' when 2 then 'BadVersion' end as code, case when n_nationkey % 4 = 3 then 2 else 1 end as rows from nation")
def sframe_errors(spark, sf_dir):
    """Junk at the start, a cut payload, a wrong version; junk between frames is passed over."""

    def damaged(path, items):
        f, k = frames.encode_frame("DATA", 1, 1, 1, b"abc", frames.FIN), int(path) % 4
        return (b"junk" + f, f[:-1], f[:2] + b"\x09" + f[3:], f + b"junk" + f)[k]

    files = encoded(_items(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), "n_nationkey"), damaged)
    return formats.decode(files, "sframe", "frames").groupBy("path").agg(F.max("error.code").alias("code"), F.count("*").cast("int").alias("rows"))


# -- delivery ----------------------------------------------------------------------------------

_ARRIVALS = """
    with m as (select user_id, row_number() over (partition by user_id order by event_id) as msg_id, (event_id * 7919) % 10007 as spread, event_id from events),
    h as (select user_id, msg_id, spread, event_id, 0 as again from m where msg_id % 5 <> 0 union all select user_id, msg_id, 20000 + spread, event_id, 1 from m where msg_id % 5 <> 0 and msg_id % 7 = 0),
    a as (select user_id, msg_id, row_number() over (partition by user_id order by spread, event_id, again) as arrival from h),
    c as (select *, arg_min(msg_id, arrival) over (partition by user_id) as cursor, row_number() over (partition by user_id, msg_id order by arrival) as nth from a),
    k as (select *, msg_id < cursor or nth > 1 as dup from c),
    r as (select user_id, msg_id, cursor, lag(msg_id) over (partition by user_id order by msg_id) as prev from k where not dup)"""


def _arrivals(spark, sf_dir):
    from pyspark.sql import Window

    by = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long")
    m = table(spark, sf_dir, "events").select("user_id", "event_id", by("event_id").alias("msg_id"), ((F.col("event_id") * 7919) % 10007).alias("spread")).where("msg_id % 5 <> 0")
    twice = m.withColumn("again", F.lit(0)).unionByName(m.where("msg_id % 7 = 0").withColumn("spread", F.col("spread") + 20000).withColumn("again", F.lit(1)))
    return twice.select("user_id", "msg_id", by("spread", "event_id", "again").alias("arrival"))


@query(_ARRIVALS + " select user_id, msg_id from r")
def delivery_released(spark, sf_dir):
    """Shuffled arrivals with holes and repeats: what waits behind a hole is released at the end."""
    from tessera.streaming.folds import fold_batch

    return fold_batch(_arrivals(spark, sf_dir), ["user_id"], "arrival", _unbounded, "user_id long").select("user_id", "msg_id")


@query(_ARRIVALS + """
    , g as (select user_id, count(*) as released, count(*) filter (prev is not null and prev <> msg_id - 1) as gaps, min(case when prev is not null and prev <> msg_id - 1 then msg_id end) as hole from r group by user_id),
    b as (select user_id, count(*) filter (msg_id >= hole) as buffered from r join g using (user_id) group by user_id), d as (select user_id, count(*) filter (dup) as dups from k group by user_id)
    select user_id, released, buffered, gaps, dups from g join b using (user_id) join d using (user_id)""")
def delivery_totals(spark, sf_dir):
    """Released, held back until the end, holes and repeats of each stream."""
    from tessera.streaming.folds import fold_batch

    return fold_batch(_arrivals(spark, sf_dir), ["user_id"], "arrival", _unbounded_totals, "user_id long")


def _unbounded():
    return folds.DeliveryFold(1 << 40)


def _unbounded_totals():
    return folds.DeliveryTotals(1 << 40)


@query("""
    with e as (select user_id, event_id, event_type, floor(value)::bigint as v from events),
    k as (select *, case when event_type = 'signup' then 'WINDOW' when event_type = 'click' then 'ACK' else 'SEND' end as kind from e),
    a as (select *, coalesce(max(case when kind = 'WINDOW' then v * 10 end) over w, 0) as adv, sum(case when kind = 'SEND' then v else 0 end) over w as s from k window w as (partition by user_id order by event_id rows unbounded preceding)),
    t as (select *, (s + least(0, min(adv - s) over (partition by user_id order by event_id rows unbounded preceding)))::bigint as sent from a)
    select user_id, event_id, kind, sent, greatest(adv - sent, 0)::bigint as available, kind = 'SEND' and sent - coalesce(lag(sent) over (partition by user_id order by event_id), 0) < v as blocked from t""")
def flow_fold(spark, sf_dir):
    """Credit-based sending as a stateful fold; flow_control has it as windows."""
    from tessera.streaming.folds import fold_batch

    kind = F.when(F.col("event_type") == "signup", "WINDOW").when(F.col("event_type") == "click", "ACK").otherwise("SEND")
    amount = F.floor("value").cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.when(kind == "WINDOW", amount * 10).otherwise(amount).alias("amount"), F.lit(0).cast("long").alias("point"))
    return fold_batch(rows, ["user_id"], "event_id", _flow_rows, "user_id long")


class _FlowRows(folds.FlowFold):
    SCHEMA = "event_id long, kind string, sent long, available long, blocked boolean"

    def step(self, r):
        for kind, _, sent, _, available, blocked, _ in super().step(r):
            yield r["event_id"], kind, sent, available, blocked


def _flow_rows():
    return _FlowRows()


@query("""
    with l as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) as nth, (l_partkey + l_linenumber) % 3 = 0 as fin from (select distinct l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by all)),
    w as (select *, max(l_linenumber * 10) over (partition by l_orderkey order by nth rows unbounded preceding) as reach from l)
    select l_orderkey, max(l_linenumber * 10) as length, arg_max(case when fin then reach end, case when fin then nth end) as total, count(*) = max(l_linenumber) and coalesce(max(l_linenumber * 10) >= arg_max(case when fin then reach end, case when fin then nth end), false) as is_complete from w group by l_orderkey""")
def fin_lengths(spark, sf_dir):
    """Message lengths by the high-water mark at the last final fragment, and completeness."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lines = lines.withColumn("at", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber"))).withColumn("b", (F.col("l_linenumber") - 1) * 10).withColumn("e", F.col("l_linenumber") * 10)
    total = sequences.final_lengths(lines, ["l_orderkey"], "at", "e", (F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0)
    islands = sequences.coalesce_ranges(lines, ["l_orderkey"], "b", "e").join(total, "l_orderkey")
    done = sequences.complete(islands, ["l_orderkey"], "total")
    return done.join(total, "l_orderkey").select("l_orderkey", "length", "total", "is_complete")
