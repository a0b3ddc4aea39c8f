"""The corpus pipeline: language identification, near-duplicate and repeat removal, personal data, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, all but the last with the columns of ``documents``. No stage expresses in SQL (see the
tests for the brute-force versions), so ``ORACLE_SQL`` is None. Every stage takes null and empty
texts, repeated rows and empty tables as its operator's module states; columns other than those of
``documents`` are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import langid, packing, pii, simhash, suffix_dedup
from meshlark.session import shipped
from meshlark.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source")
#: Words of a repeated passage.
PASSAGE = 50


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay: texts with letters, enough of whose n-grams are known."""
    filters = langid.learn(langid.training_rows(docs))
    found = langid.identify(docs, filters, keep=("text", *OTHERS, "n_chars"))
    return found.where("accepted").select(*COLUMNS)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest id."""
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


@shipped
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id has too are cut out; one copy stays."""
    found = suffix_dedup.remove_repeats(docs, span=PASSAGE, keep=OTHERS, unit="word", leave_first=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@shipped
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the names of their kinds."""
    found = pii.personal_data(docs, keep=OTHERS)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@shipped
def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("pii", redact_personal_data),
    ("packing", pack_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs, tmp = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tmp.write(docs, name)
    return docs
