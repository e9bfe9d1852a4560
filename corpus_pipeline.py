"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A document is dropped only
for a reason of its stage: no letter in it, a smaller id in its group of near copies, or benchmark passages in more
than half of its words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import decontaminate, language, near_texts, packing, pseudonyms
from repolith.llm.common import NO_ID, table, written

#: The near-duplicate stage compares five-word shingles. Fingerprints within the radius are candidates, as are texts that share a MinHash
#: band; only an exact similarity of 0.8 or more links them.
NEAR_WORDS, NEAR_RADIUS = 5, 6


#: Rows that travel to a Python task at a time. Documents are long: ten thousand of them, the session's own number, take a
#: good part of an executor's memory in each of its tasks.
BATCH = 500


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def _columns(frame: DataFrame, docs: DataFrame) -> DataFrame:
    return frame.select(*(F.col(f"`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language, whatever the label was; null texts and texts without a letter are rejected.

    Only those have no language (``und``). A low score rejects nothing: the nearest language is still the best guess.
    If no row has both a label and a text there is no model, and everything is rejected.
    """
    _small_batches(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model).where(F.col("lang_pred") != language.UNKNOWN)
    return _columns(found.withColumn("lang", F.col("lang_pred")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, whose rows stay as they are.

    Rows that repeat a doc_id are one document to this stage. A row without a doc_id stays only if no row of its
    group has one.
    """
    _small_batches(spark)
    groups = near_texts.near_texts(docs, NEAR_WORDS, NEAR_RADIUS)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept")).distinct()
    return _columns(docs.join(kept, F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("_kept"), "left_semi"), docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages go, with what stands between them; a document that is such in more than half of its words goes as a whole.

    Texts without a passage stay to the byte, null and blank ones too. Repeated rows are judged alike, null doc_ids like
    any other. An empty benchmark changes nothing, and an empty table gives none.
    """
    _small_batches(spark)
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses that tell of persons become others of their format, the same ones in all documents.

    All rows stay; null, empty and very long texts, repeated rows and null doc_ids are as they were but for that.
    """
    return _columns(pseudonyms.pseudonymise(docs, pseudonyms.QUERY_KEY), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens (see packing.pack()): every token lies in exactly one.

    A null or empty text is one token, its end. Rows without a doc_id come last; repeated ids stay apart. An empty table
    gives no pieces.
    """
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", mask_private_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the code lengths nor the automaton, the tokens or the plan of cuts; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
