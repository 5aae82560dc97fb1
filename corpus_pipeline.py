"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontaminate, nbsvm, pii_bootstrap, sentencepiece_codec, simhash_segments
from curatrix.llm.common import free_name, read_table, shared_folder
from curatrix.llm.queries import QUALITY_AT, SENTENCEPIECE_MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: fingerprints of three-word shingles that differ in three bits at most.
NEAR = {"shingle": 3, "distance": 3}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on all labels that the sample's bound admits, accepts. A null
    text scores like an empty one; equal rows stay or go together; no column is added."""
    model = nbsvm.train(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    score = free_name(docs, "score")
    return nbsvm.score(docs, "text", model, score).filter(F.col(score) >= QUALITY_AT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of fingerprints connect: that with the smallest doc_id, null
    last. A null text is an empty one, and all empty texts are one group; equal rows are one group."""
    return simhash_segments.one_of_each(docs, "doc_id", "text", **NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words stands in windows of benchmark items. A null or
    empty text has no words and stays; equal rows stay or go together; no column is added."""
    items = read_table(spark, sf_dir, "benchmark")
    return decontaminate.drop_contaminated(docs, "doc_id", "text", items, "item_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind and n_chars counted again. A null text stays
    null; equal rows are redacted alike; no column is added."""
    made = pii_bootstrap.redact(docs, "doc_id", "text")
    if "n_chars" not in docs.columns:
        return made
    kind = docs.schema["n_chars"].dataType
    return made.withColumn("n_chars", F.length("text").cast(kind))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids, and whether decoding gives the text back. A null or empty text
    has no ids; equal rows get equal ids; input columns named like the new ones are replaced by them."""
    return sentencepiece_codec.encode_texts(docs, "text", SENTENCEPIECE_MODEL)


#: (name, function of spark, docs, sf_dir).
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: A fitted classifier, SimHash and a tokenizer are not SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet in the shared folder
    and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
