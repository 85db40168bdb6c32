"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function of spark, docs and the tables' folder). All but the
last return the columns of ``documents``; the last returns one row per packed
piece. Toxic documents go, one document of each near-duplicate component stays,
secrets are masked in the text, documents are repeated and cut to the mix of
sources, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, neardup, packing, secrets, toxicity
from quillon.llm.common import fold, stored, table

#: Rows of ``labels`` whose crc32(doc_id) is this modulo the first are held out.
HELD_OUT = (5, 0)
TOXIC_FROM = 0.5
#: Words of a shingle in the near-duplicate stage.
WORDS = 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentences reaches TOXIC_FROM go."""
    learnable = F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1], F.lit(True))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable)
    return toxicity.scored(docs, model, into="_quillon_toxicity").filter(F.col("_quillon_toxicity.score") < TOXIC_FROM).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component stays:
    similarity 0.8 or more on five words, as for all stages without a contract of their own."""
    return neardup.deduplicated(docs, k=WORDS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are masked; every document stays."""
    return secrets.redacted(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last pass cut between words."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
