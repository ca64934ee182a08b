"""A pipeline for training text: language ID, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
back as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language_id, line_dedup, mixing, ngram_join, packing
from kindred.llm.common import DOCUMENT_COLUMNS, as_documents, stored, table
from kindred.llm.queries import default_tokenizer

#: the least share of the winning language with which a document is not rejected
SURE = 0.5
#: the part of all tokens that mixing keeps
BUDGET = 0.9


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    rows = language_id.identify(docs, language_id.fit(docs))
    return as_documents(rows.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near copies of lines go, and documents of which nothing is left."""
    rows = line_dedup.dedup(as_documents(docs))
    rows = rows.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))) > 0))
    return as_documents(rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the least id stays."""
    groups = ngram_join.join(docs, n=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return as_documents(docs.join(gone, "doc_id", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their tempered shares."""
    rows = mixing.mix(docs, budget=BUDGET, temper=0.9, keep=True)
    return as_documents(rows.where("sampled"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: no SQL expresses a trained language model, components or packing; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
