"""What several operators of this package share: durable cuts of lineage, shared folders, components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset, and gets a temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder (not yet created)."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _tidy(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: nothing reads them once the rows are in the shared folder."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: lost executors cannot take them, and the plan starts anew."""
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting


def dealt_anew(key: Column) -> Column:
    """A long key with the same value that the planner does not know to be dealt by already.

    Joined on it, an aggregate gets an exchange of its own, and adaptive execution can split the hot keys of the
    other side; without one it cannot.
    """
    return F.bitwise_not(F.bitwise_not(key))


def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most rows rows for what runs inside: for rows of many KB, of which 10,000 would fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return _setting(spark, name, str(min(rows, before) if before > 0 else rows))


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_BYTES from now on, so that neither long texts nor many rows fill a worker.

    The setting stays, as it has to hold when a query is run, which is later; a lower one is kept.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name, None)))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bit maps of 512 words of 64 bits each that a sieve has: 256 x 4 KB = 1 MB broadcast, whatever the input.
SIEVE_BUCKETS = 256
_WORDS = 512


def _slot(key: Column) -> tuple[Column, Column, Column]:
    """Bucket, word and bit of a long key."""
    at = F.pmod(key, F.lit(SIEVE_BUCKETS * _WORDS * 64))
    return F.shiftright(at, 15).cast("int"), F.shiftright(at, 6).bitwiseAND(F.lit(_WORDS - 1)).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame) -> DataFrame:
    """SIEVE_BUCKETS rows (_bucket, _bits) that hold a bit for each of keys.key."""
    bucket, word, bit = _slot(F.col("key"))
    one = F.lit(1).cast("long")
    held = keys.groupBy(bucket.alias("_bucket"), word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("_set"))
    at = F.col("id")
    none = keys.sparkSession.range(SIEVE_BUCKETS * _WORDS).select((at / _WORDS).cast("int").alias("_bucket"), (at % _WORDS).cast("int").alias("_word"), F.lit(0).cast("long").alias("_set"))
    words = held.unionByName(none).groupBy("_bucket", "_word").agg(F.bit_or("_set").alias("_set"))
    row = F.sort_array(F.collect_list(F.struct("_word", "_set")))
    return words.groupBy("_bucket").agg(F.transform(row, lambda x: x["_set"]).alias("_bits"))


def passes(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """rows with a column _maybe: whether the key's bit is set in a sieve."""
    bucket, word, bit = _slot(key)
    rows = rows.withColumn("_bucket", bucket).withColumn("_word", word).withColumn("_bit", bit)
    rows = rows.join(F.broadcast(bits), "_bucket", "left")
    maybe = F.getbit(F.element_at("_bits", F.col("_word") + 1), F.col("_bit")) == 1
    return rows.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("_bucket", "_word", "_bit", "_bits")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: ``(node, component)`` with the smallest node as name.

    Alternates two steps until every node points at the root of a star: each node hands all its larger neighbours to
    its least one, then all its smaller neighbours. Stars take one round and long chains a logarithmic number.
    Only keyed aggregations and equi-joins are used, and what a hub receives is aggregated before the shuffle.
    Nodes without edges are not returned; null ends and self loops are ignored.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    e = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct())
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew(F.col("u")).alias("v"), F.least("u", "m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew(F.col("u")).alias("u"), "m")
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def store(df: DataFrame, what: str) -> DataFrame:
    """Like cut, as compressed Parquet: for tables too large for a checkpoint's plain rows."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_dir(spark, what)
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, path)


def row_digest(text: Column) -> Column:
    """What tells texts apart where rows are joined back: the SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def without_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs but for the documents that verdicts (id, digest, drop) drop; of those with drop false, one row each stays.

    A document is a row's id (null is one too) and text, of which digest is the row_digest. Documents without a verdict
    keep all their rows. Only rows whose id passes a sieve of the ids in verdicts are moved to compare.
    """
    found = cut(verdicts.select(F.col("id").cast("long").alias("__i"), F.col("digest").alias("__h"), F.col("drop").alias("__drop")).distinct())
    bits = cut(sieve(found.select(F.xxhash64("__i").alias("key"))))
    marked = passes(docs.withColumn("__i", F.col(id_col).cast("long")), F.xxhash64("__i"), bits)
    sure, maybe = marked.where("not _maybe"), marked.where("_maybe").withColumn("__h", row_digest(F.col(text_col)))
    found = found.withColumnsRenamed({"__i": "__j", "__h": "__g"})
    maybe = maybe.join(found, (F.col("__h") == F.col("__g")) & F.col("__i").eqNullSafe(F.col("__j")), "left")
    once = maybe.where("not __drop").dropDuplicates(["__i", "__h"])
    names = docs.columns
    return sure.select(*names).unionByName(maybe.where("__drop is null").select(*names)).unionByName(once.select(*names))
