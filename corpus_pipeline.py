"""The corpus pipeline: documents through language ID, near-dedup, secret redaction, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder and rereads it as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, minhash_dedup, mixing, packing, secrets
from tessera.llm.common import stage
from tessera.llm.queries import documents, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or a letter go.

    Where no document has a label there is nothing to learn from, and every document with a letter stays.  Null and empty texts go,
    texts of any length are taken whole, repeated rows share their fate, ties of languages go by name, an empty table stays empty and other
    columns are not passed on.
    """
    model = language_id.fit(docs)
    if not model.samples:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, one without doc_id only where no other is there.

    Rows are told apart by themselves: texts that share a doc_id but not their words stay, repeated rows do not.  Documents
    without a word have no copies and stay.  Texts of any length are taken whole; an empty table stays empty; other columns are not passed on.
    """
    return minhash_dedup.deduplicated(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars counted anew.

    A null text stays null and an empty one empty; texts of any length are taken whole; repeated rows come out alike; an
    empty table stays empty; other columns are not passed on.
    """
    found = secrets.scan(docs.select(*COLUMNS), keep=list(COLUMNS))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: not at all, once or twice.

    A null source is one of its own; documents without a word stay once; rows that share a doc_id, or have none, are taken as the mean of
    their shares; ties go by doc_id and size; an empty table stays empty; other columns are not passed on.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A null or empty text is its closing token alone; longer texts than a sequence are cut; every row is packed, repeated ones each for
    itself; which of equally long pieces lies where is by doc_id; an empty table gives no pieces.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the trained language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
