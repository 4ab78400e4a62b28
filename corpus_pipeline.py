"""From raw documents to packed sequences: five stages, each written and read again by the next.

toxicity       rejects documents scored toxic (maximal scoring segments)
quality        rejects documents scored low (attention over passages)
line_dedup     one line of each fuzzy group stays; a document left without lines goes
ngram_join     one document of each group of near copies stays (five words, similarity 0.8)
packing        the rest in sequences of 1024 tokens

All stages but the last return the columns of documents. The classifiers learn from the labelled
rows among the documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.line_dedup import deduplicate_lines
from clickwarden.llm.ngram_join import ngram_components
from clickwarden.llm.packing import pack_documents
from clickwarden.llm.quality import fit_quality, with_quality
from clickwarden.llm.scratch import Scratch, unused_names
from clickwarden.llm.toxicity import fit_toxicity, with_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _accepted(docs: DataFrame, scored: DataFrame, score: str, accept: str) -> DataFrame:
    return scored.where(f"`{score}` {accept} 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, all columns as they are.

    A null or empty text has the score of a text without evidence. Rows that repeat each other or a doc_id are judged
    by their own texts; a row without doc_id is judged like others. An empty table stays empty.
    """
    (score,) = unused_names(docs, "score")
    return _accepted(docs, with_toxicity(docs, fit_toxicity(docs, _labels(spark, sf_dir)), score), score, "<")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more, all columns as they are; odd rows as in ``reject_toxic``."""
    (score,) = unused_names(docs, "score")
    return _accepted(docs, with_quality(docs, fit_quality(docs, _labels(spark, sf_dir)), score), score, ">=")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a similar line before them stands for; ``n_chars`` follows the text.

    Null texts, documents without a line to compare and rows without doc_id stay as they are. Of equal lines of rows that
    repeat a doc_id, those at equal places stay or go together. A document of any length is compared whole.
    """
    kept = deduplicate_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id, all columns as they are.

    A text without words has no copies and stays. Of rows with one doc_id and text one stays, the smallest by all its
    other columns; rows without doc_id stay if their component has no id. An empty table stays empty.
    """
    groups = ngram_components(docs, n=5, percent=80)
    own, place = unused_names(docs, "kept", "place")
    stays = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(stays.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_semi")
    # a row that repeats another is its copy
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    return kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences.

    A null text is empty and still has its end mark. Every row is packed, repeated ones and rows without doc_id too;
    other columns are ignored. An empty table has no piece.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("packing", pack),
]
#: The classifiers and the fuzzy stages can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
