"""A corpus pipeline of five stages, each made by one operator of kerbline.llm.

Every stage takes the session, the documents that its predecessor kept, and the folder of the tables.  The first four
return the columns of `documents`, whatever further ones there are and however they are called; the last one returns the
index of the token files.  An empty table passes through all stages and gives an empty index; repeated rows are judged
alike and stay repeated until the mixture draws their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm import decontam, langid, mixing, neardup, token_store
from kerbline.llm.shared import cut

#: Texts whose language is less certain than this are rejected, beside those without any letter; mixed texts stay.
LEAST_CERTAIN = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the byte network knows.

    A null text and one without a letter have no language and go; a null `lang` is only not learned from.  Without any
    labelled text nothing can be known and nothing is kept.
    """
    said = langid.identify(docs.select("text", F.struct("*").alias("row")), langid.model_of(docs))
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)
    return said.filter(kept).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without words are no duplicates of each other and stay; so do all rows of a kept id, and rows without an id.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window of ten words with a benchmark item.

    Documents without words, and all documents if the benchmark has none, stay; a null id is judged like any other.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.decontaminated(docs, items).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as the square root of their rows, in a global random order.

    A null source is a source of its own; a null text counts as a row; repeated rows of one id are repeated alike.
    """
    return mixing.mix(docs.select("doc_id", "source", F.struct("*").alias("row")), power=0.5).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the mixture's order and returns their index.

    The order is that of the mixture's hash of id and copy number, so copies of a document lie apart.  Equal rows are
    numbered in no particular order, which no one can tell.  A null text is the end id alone.
    """
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    ordered = docs.select("doc_id", "text", mixing.order_key(F.col("doc_id"), F.row_number().over(copies) - 1).alias("place"))
    return token_store.index(token_store.store(ordered, token_store.default_tokenizer(), order="place"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL cannot express the trained network and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
