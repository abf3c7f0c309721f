"""Queries on the section, node and metadata tables of containers. Node tables hold a tree in pre-order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_sections(sections: DataFrame, type_name: str) -> DataFrame:
    """All sections of a type, in the order of the table."""
    return sections.where(F.col("type") == type_name).orderBy("path", "section_idx")


def find_section(sections: DataFrame, type_name: str | None = None, ident: int | None = None) -> DataFrame:
    """The first section of each container with a type, or with an id; ids need not be unique."""
    wanted = F.col("type") == type_name if type_name is not None else F.col("id") == ident
    rest = [c for c in sections.columns if c != "path"]
    first = sections.where(wanted).groupBy("path").agg(F.min_by(F.struct(*rest), "section_idx").alias("_s"))
    return first.select("path", *[F.col(f"_s.{c}").alias(c) for c in rest])


def metadata_value(metadata: DataFrame, key: bytes) -> DataFrame:
    """The first entry with a key in each container."""
    rest = [c for c in metadata.columns if c not in ("path", "error")]
    first = metadata.where(F.col("key") == F.lit(bytearray(key))).groupBy("path").agg(F.min_by(F.struct(*rest), "ordinal").alias("_m"))
    return first.select("path", *[F.col(f"_m.{c}").alias(c) for c in rest])


def typed(tag: str) -> Column:
    """The value of a metadata entry if its tag is exactly this one; nothing is converted."""
    return F.when(F.col("tag") == tag, F.col({"INT": "i64", "UINT": "u64", "STRING": "str"}[tag]))


def collect_records(nodes: DataFrame, tag: str, recursive: bool = True, section: int | None = None) -> DataFrame:
    """All records with a tag, in pre-order; top-level ones only unless recursive."""
    found = nodes.where(F.col("tag") == tag)
    if not recursive:
        found = found.where("depth = 0")
    if section is not None:
        found = found.where(F.col("section_idx") == section)
    return found.orderBy("path", "section_idx", "pre_order")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Groups, arrays, keyvals, scalars and the greatest depth of each container."""
    inner = ("GROUP", "ARRAY", "KEYVAL")
    counts = [F.count_if(F.col("tag") == t).alias(f"{t.lower()}s") for t in inner]
    return nodes.groupBy("path").agg(*counts, F.count_if(~F.col("tag").isin(*inner)).alias("scalars"), F.max("depth").alias("max_depth"))


def item_count_mismatches(sections: DataFrame) -> DataFrame:
    """Sections that declare another number of records than they hold; FREE ones hold none."""
    return sections.where((F.col("type") != "FREE") & (F.col("item_count") != F.col("records"))).select("path", "section_idx", "item_count", "records")


def report(containers: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, errors, warnings, ok) of every container: ok without errors, whatever the warnings."""
    found = issues.where("severity is not null").groupBy("path").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    out = containers.select("path").join(found, "path", "left")
    return out.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings")], (F.coalesce("errors", F.lit(0)) == 0).alias("ok"))


def field(fields: Column | str, at: int) -> Column:
    """The field at a position, from 0; null where the record has fewer."""
    return F.get(fields, F.lit(at))


def render_field(f: Column) -> Column:
    """A store's field as text."""
    text = lambda name: F.col(name) if isinstance(f, str) else f[name]
    reference = F.when(text("ref_resolved"), text("str").cast("string")).otherwise(F.concat(F.lit("#"), text("ref_id").cast("string")))
    return (
        F.when(text("type") == "NULL", "null").when(text("type") == "BOOL", text("b").cast("string")).when(text("type") == "INT", text("i64").cast("string"))
        .when(text("type") == "UINT", text("u64").cast("string")).when(text("type") == "FLOAT", text("f64").cast("string")).when(text("type") == "STRING_REF", reference)
        .when(text("type") == "INLINE_STRING", text("str").cast("string")).otherwise(F.concat(F.lit("blob["), F.octet_length(text("blob")).cast("string"), F.lit("]")))
    )


def project_row(records: DataFrame) -> DataFrame:
    """records with a column values: each field as text, floats as %g writes them."""
    from tessera.functions.registry import general_texts

    # Floats are written by one function for the whole row, as C does; all else is column expressions.
    floats = records.withColumn("_g", general_texts(F.transform("fields", lambda f: f["f64"])))
    text = F.zip_with("fields", "_g", lambda f, g: F.when(f["type"] == "FLOAT", g).otherwise(render_field(f)))
    return floats.withColumn("values", text).drop("_g")
