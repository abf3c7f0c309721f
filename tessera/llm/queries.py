"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), digest_col="text_sha256")


def op1_packing(spark, sf_dir):
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_warc(spark, sf_dir):
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import repeated_substrings

    out = repeated_substrings(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_secret_scan(spark, sf_dir):
    from .secret_scan import scan_secrets, spans_text

    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["rank"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["rank"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


def op6_pii(spark, sf_dir):
    """The key is the session's ``spark.tessera.pii.key``; where it is unset, each call takes a new random one, which nobody keeps."""
    import secrets

    from .pii import KINDS, pseudonymise

    key = spark.conf.get("spark.tessera.pii.key", None) or secrets.token_hex(32)
    done = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("pii_spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return done.select("doc_id", *[count(k) for k in KINDS], spans.alias("spans"), F.transform("pii_spans", lambda x: x["new"]).alias("pseudonyms"), "text")


def op7_language_id(spark, sf_dir):
    from .language_id import held_out, identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_bpe(spark, sf_dir):
    from .bpe import bpe_round_trip

    out = bpe_round_trip(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_minhash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {"op1_packing": op1_packing, "op2_embedding_dedup": op2_embedding_dedup, "op3_warc": op3_warc, "op4_suffix_dedup": op4_suffix_dedup, "op5_secret_scan": op5_secret_scan, "op6_pii": op6_pii, "op7_language_id": op7_language_id, "op8_bpe": op8_bpe, "op9_exact_dedup": op9_exact_dedup, "op10_minhash": op10_minhash}

ORACLE = {
    "op3_warc": """
        select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
               case when strlen(coalesce(html, '')) >= 100 and page_id <> min(page_id) over w then 'revisit' else 'response' end as record_type,
               case when strlen(coalesce(html, '')) >= 100 and page_id <> min(page_id) over w then min(page_id) over w end as refers_to
        from pages window w as (partition by coalesce(html, ''))""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
}
