"""From raw documents to training tokens: five stages, each one operator of ``variorum.llm``.

Every stage but the last takes and returns the columns of ``documents``; ``run``
writes each stage's rows to a table and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import bpe, language, mixing, pii, simhash
from variorum.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts that are null, without a letter or undecided (``language.MIN_SCORE``) go.

    Repeated rows stay repeated, null ids stay, further columns stay; an empty table gives no rows.
    """
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each component of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Null and wordless texts are copies of one another; repeated rows are one; null ids
    come last; an empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text.

    Null texts stay null, with a null ``n_chars``; empty and repeated rows stay; an empty table gives no rows.
    """
    # numbered names can't meet the column of spans
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = own["text"]
    out = pii.redact(pii.find_pii(docs.toDF(*own.values()), text), text).withColumn(own["n_chars"], F.length(text).cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0, 1 or 2 times) as the mix of sources takes them.

    Null texts and texts without a word are not taken; a null source is a source; an empty table gives no rows.
    """
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the hash of the decoded bytes of each document.

    Null and empty texts give no ids; repeated rows stay repeated; an empty table gives no rows.
    """
    return bpe.training_rows(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("pii", private_data),
    ("mix_sources", mix),
    ("bpe", tokenize),
]

#: language models and the seeded draws have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
