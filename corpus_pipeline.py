"""A training corpus from raw documents: classify, deduplicate, remove passages, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and rereads it as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import ngramjoin, packing, quality, secrets, suffixdedup
from textloom.llm.common import stored, table

LEAST_QUALITY = 0.3
#: Passages of so many words go; the shortest of them had 152 bytes in a sample of sf0.01.
WORDS, LENGTH, GRAM = 51, 150, 75


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngramjoin.one_of_each(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words or 400 bytes that occur more than once are cut out; documents stay, if only with what is left of them."""
    return suffixdedup.remove(docs, words=WORDS, length=LENGTH, gram=GRAM).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    model = secrets.train(secrets.default_samples(spark))
    found = secrets.find(docs, model, out="_secrets")
    out = found.withColumn("text", secrets.redacted(F.col("text"), F.col("_secrets"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", remove_passages),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the passage stage with a brute-force version, the others are tested as operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
