"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on the whole of what the one before kept, calls one operator, and is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontamination import contaminated
from tickloom.llm.language_id import fit, predict
from tickloom.llm.near_dedup import near_duplicates
from tickloom.llm.packing import packed_documents
from tickloom.llm.shared import Scratch, one_row_per_id, without_id_in
from tickloom.llm.substring_dedup import repeated_passages, without_passages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its text has no letter or its language is less certain than this.
LEAST_CERTAIN = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and letter-free texts go, and texts whose likeliest language has less than LEAST_CERTAIN; repeated rows and rows with a null
    id are told each for itself; without any labelled text, and of an empty table, nothing is left; other columns than COLUMNS go.
    """
    told = predict(docs.select(*COLUMNS), fit(docs.select("doc_id", "text", "lang")))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Rows of one id are one document, the row whose text sorts first; rows without an id, and documents without a word, stay.
    """
    docs = one_row_per_id(docs.select(*COLUMNS))
    gone = near_duplicates(docs, n=5, percent=80).where("NOT kept").select("doc_id")
    return without_id_in(docs, gone).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier document has too; n_chars is that of the text that is left.

    Documents of which nothing is left go; rows of one id are one document, the row whose text sorts first; rows without an id or a text stay as they are.
    """
    docs = one_row_per_id(docs.select(*COLUMNS))
    return without_passages(docs, repeated_passages(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A text decides for all rows that hold it, whatever their ids, null ones too; null and empty texts stay; with an empty benchmark all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mark = F.md5(F.col("text").cast("binary"))
    found = contaminated(docs.select(mark.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__mark")).distinct()
    return docs.select(*COLUMNS).join(found, mark == F.col("__mark"), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence, and where it stands there.

    Documents without a token are a row without a sequence; repeated rows and rows with a null id are packed each for itself.
    """
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hashing, alignment and packing can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
