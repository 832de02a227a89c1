"""The operators as stages of a corpus pipeline: documents in, documents (or, at the end, pieces) out.

Every stage keeps all columns of its input, brings n_chars up to date where it changes texts, and keeps rows with
null texts, unless its own decision says otherwise: toxicity scores those as empty texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import jaccard, lines, packing, secrets, toxicity
from wayline.llm.queries import labelled, small_batches
from wayline.session import table, unused


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))
    return docs.withColumn("n_chars", length.cast(kind))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model learns from this run's labels."""
    small_batches(spark)
    model = toxicity.train(labelled(docs, table(spark, sf_dir, "labels")))
    name = unused("__toxicity", docs.columns)
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go from the texts, and with them documents of which nothing
    is left: the copies. Documents that were blank or null before stay."""
    small_batches(spark)
    return _measured(lines.without_repeats(docs, emptied=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the row with the least id stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs, n=5, share=(80, 100))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask; all documents stay."""
    small_batches(spark)
    return _measured(secrets.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 2048 tokens, with a checksum of each piece's ids."""
    small_batches(spark)
    return packing.with_crc(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))
