"""A corpus pipeline of five stages, each written and read again before the next.

Every stage works on all rows that the stage before kept and returns all columns of ``documents``, whatever else the table holds under
whatever names; only packing returns its own. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrain.llm import bagminhash, packing, pii, quality, templates
from dealgrain.llm.tables import read
from dealgrain.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and blank texts have too few words and go; a text of any length is judged whole; null ids and repeated rows are
    judged like any other.
    """
    return quality.quality_filter(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Of equal ids the first text by its digest stays, of repeated rows any one (with its own other columns). A null id is kept only
    where its whole group has none. Texts without words are in no group and stay.
    """
    return bagminhash.keep_one_per_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its numbers, names and units.

    Null and empty texts, and null, empty and very short items, match nothing. Repeated rows go or stay together; null ids count as one id.
    """
    return templates.drop_leaked(docs, read(spark, folder, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by placeholders; n_chars is the new length.

    A null text stays null and so does its length; of overlapping finds the first names the placeholder.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of binary lengths, a sequence each.

    A null or empty text is its end id alone. Repeated rows are packed each; null ids are kept.
    """
    return packing.pack_documents(docs, added_as_text=False)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_copy),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", redact_personal),
    ("packing", pack),
]

#: SQL can express neither the boosted trees nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = read(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs
