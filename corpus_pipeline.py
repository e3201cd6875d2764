"""From documents to tokens: five operators of the llm subpackage in a row, each stage written and read again.

An empty table goes through all stages. Null texts count as empty and end at
the quality rules. Further columns stay until the last stage. Ties and repeated
rows are settled by each stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, credentials, minhash, mixing, queries, rules
from tessera.llm.storage import materialize

#: Weights of sources by code point, repeating, and how often a document may be taken.
WEIGHTS = (1, 2, 3)
REPEATS = 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps. Each row is judged by its own text, so rows without id and repeated rows stay if that is good."""
    return rules.keep_documents(docs, rules.DEFAULT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: shingles of five words, similarity 0.8.

    The row with the smallest id stays, rows without id come last, the first one
    on ties. Rows without id are documents of their own; texts without a word are no copies.
    """
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked and ``n_chars`` brought up to date; null texts stay null."""
    return credentials.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, 0 to 3 times; a null source is a source. Rows of equal id and text share their fate."""
    return mixing.mixed_documents(docs, WEIGHTS, REPEATS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row taken; null texts have no tokens."""
    return bpe.encoded(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Sketches, inferred automata and BPE are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
