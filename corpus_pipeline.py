"""From raw documents to encoded training texts, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are written
as a table in the shared checkpoint folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldlake.llm import language_id, line_dedup, mixing, ngram_join, sentence_pieces
from yieldlake.scale import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_ROWS = 1000  # texts are long: Arrow batches of Spark's 10,000 rows would hold tens of megabytes on both sides


def _texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, with Arrow batches of few rows for the stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null texts and those without a letter go.

    Rows that repeat are judged alike, an empty table stays empty, columns beyond those of documents are left out.
    """
    docs = _texts(spark, docs)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).where("accepted").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred before; documents of such lines alone go.

    Null texts stay null, blank lines stay, rows that repeat key and text are treated alike.
    """
    return line_dedup.kept_documents(_texts(spark, docs))


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """The first row, by its columns, of each id; rows with a null id stay."""
    again = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return cut_lineage(docs.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(first))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of similar ones; one row of rows that share an id.

    Documents without a word and rows with a null id stay.
    """
    docs = _one_row_an_id(_texts(spark, docs))
    gone = ngram_join.similar_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null texts count as texts of no words."""
    return mixing.mixed_documents(_texts(spark, docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of each document; a null text counts as empty."""
    return sentence_pieces.piece_digests(_texts(spark, docs), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("keep_known_language", keep_known_language),
    ("drop_repeated_lines", drop_repeated_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

ORACLE_SQL = None  # a trained language model and piece tables have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
