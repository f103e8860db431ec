"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, documents that hold benchmark
items go, personal data is replaced, and what is left is encoded for training.

All stages keep rows with a null id or text unless they say otherwise, treat equal rows alike, keep other columns and give
an empty table for an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard_join, pii, sentencepiece_codec, toxicity
from lodestone.llm.common import materialize, read_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is predicted toxic; the model learns from the labels that aren't held out. Null and empty texts have the
    score of no evidence, which is ordinary."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, similarity 0.8); texts without
    words are no copies; of repeated rows one stays."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item contaminates; all rows of such an id go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows; null texts stay null."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and the digests of ids and decoded text; null texts have no ids."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), outputs=("ids", "digest"))


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece encoding", encoded),
]
#: Compression lengths and the tokenizer cannot be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
