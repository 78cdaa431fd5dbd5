"""A corpus in five stages: toxic documents go, one of each group of near duplicates
stays, secrets are redacted, sources are laid out in the mixture's order, and what is
left is encoded. Each stage is written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import mixing, near_copies, secrets, sentencepieces, toxicity
from pagelattice.runtime import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and keeps those below their language's threshold."""
    net = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of five-word-shingle similarity 0.8 or more."""
    return near_copies.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secret values in the texts; all documents stay."""
    return secrets.redact_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays all documents out over partitions and within them in the mixture's order."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check, in the mixture's order with its ``position``."""
    placed = mixing.read_in_order(docs)
    return mixing.laid_out(sentencepieces.encode_rows(placed, keep=("position",)), "position", docs.count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Hashes of shingles, the classifier and the lattice have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(done)  # the next stage is written; nothing reads this one again
    return STAGES[-1][1](spark, docs, sf_dir)
