"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes what the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import copies, mixing, packing, privacy, quality, queries
from tallywright.workspace import settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality.kept_documents(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Near are texts that op7 links, by fingerprints within 2 bits, and texts whose five-word shingles have a
    Jaccard similarity of at least 0.8. Fingerprints miss almost all edited copies of that similarity, so those
    pairs are found by an exact prefix filter.
    """
    return copies.one_of_each(docs, by_fingerprint=True)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with all personal data masked."""
    return privacy.mask_personal(docs, privacy.fit(docs))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a copy is a row."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2,048 token ids, with the ids."""
    return packing.pack(queries.ids_of_documents(spark, docs), keep_ids=True)


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", unlike_documents),
    ("personal_data", masked_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]
#: XXH64, the random field and chance can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
