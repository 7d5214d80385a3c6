"""A training corpus from raw documents: five stages, each the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``docs``; each works on everything its predecessor kept.

Defined results: null and empty texts have too few words and go in the first stage; texts of any length are treated whole; of
rows that repeat, tie or are near each other exactly one stays, that of the smallest key (of exact copies the longest one
first), and any one where no key is there; a null key links nothing and stays null; other columns pass through whatever their
names; an empty table gives an empty result. Pseudonyms are made with the key in ``spark.docweave.pii.key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.llm import _common, feistel_pii, grace_dedup, packing, parity_join, rule_ledger


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of any length that pass the strict policy of the rule ledger."""
    return rule_ledger.keep_good(docs, "strict-2")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return grace_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return parity_join.keep_one(docs, 80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; ``n_chars`` follows the text."""
    done = feistel_pii.pseudonymise(docs, feistel_pii.key_of(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: a row per piece with its place."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII", private), ("best-fit packing", pack)]

#: SQL can express neither the pseudonyms nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
