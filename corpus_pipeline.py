"""A pipeline from raw documents to packed sequences: five stages, each an operator of tessera.llm.

Every stage takes all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, language_id, minhash, packing, secret_scan

#: A language score below this rejects a document.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark, docs, sf_dir):
    """Drops documents without a recognisable language: null or letterless texts, and scores under LEAST_LANGUAGE_SCORE.

    Where no row has a label, no language can be recognised; all texts with a letter are kept then. Ids are not looked
    at, equal rows fare alike, other columns stay as they are, and an empty table stays empty.
    """
    model = language_id.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs.select(*[F.col(c) for c in docs.columns]), model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_copies(spark, docs, sf_dir):
    """Keeps one document of each group of identical texts, the one with the largest id (null counts as smaller than any).

    Null and empty texts are identical. Rows that repeat both id and text are one document, of which one row stays, and a
    repeated id with another text is another document. Other columns are not compared; an empty table stays empty.
    """
    return common.without_rows(docs, exact_dedup.verdicts(docs))


def near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near copies (five words, 0.8), the one with the smallest id (null comes last).

    Texts without words are near copies of nothing and stay. A repeated id with another text is another document; of
    near copies with the same id the one with the smallest digest stays. Rows that repeat both id and text are one
    document, of which one row stays. Other columns are not compared; an empty table stays empty.
    """
    return common.without_rows(docs, minhash.verdicts(docs, words=5, percent=80))


def secrets(spark, docs, sf_dir):
    """Replaces every secret by a mark; n_chars follows the text. All rows stay; a null text stays null, with a null n_chars."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark, docs, sf_dir):
    """Packs all documents into sequences of at most 4096 tokens; a row for each piece."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packed", packed)]

#: A trained classifier, MinHash and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's result written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
