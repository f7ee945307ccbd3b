"""A training corpus from ``documents`` in five stages.

Each stage is a function of (spark, docs, sf_dir) that gets all that the stage before
kept. All but the last return the columns of ``documents``. Further columns of ``docs``
are left out, nulls in any column and empty tables are allowed, and texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkin.llm import compression_bands, jaccard_join, line_spread, sentence_pieces, source_mix
from rollkin.llm.queries import PIECE_MODEL, good_documents
from rollkin.sources.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands, fitted on the good labels, reject go.

    A null or empty text has under 50 words and goes. Rows that repeat share their fate.
    """
    docs = docs.select(*COLUMNS)
    return compression_bands.kept_documents(docs, compression_bands.fitted(docs, good_documents(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites and ten texts or more have go; every document stays, with its new length.

    A null text stays null, with a null length; a text of which all lines go becomes
    empty. A null source adds to no line's spread. Rows that repeat stay as often.
    """
    return line_spread.remove_boilerplate(docs.select(*COLUMNS), min_sites=10).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8, that with the smallest id.

    Texts without words stay, each of them; of rows that repeat one stays. Null ids go
    where a linked document has an id, and stay otherwise.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic weights, of 70 % of the tokens.

    Null sources and languages are values of their own; texts without a word are kept.
    Rows that repeat are kept or dropped together.
    """
    return source_mix.mix(docs.select(*COLUMNS), budget=0.7).where("kept").select(*COLUMNS)


def sentence_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text; a null text has none."""
    return sentence_pieces.round_trip(docs, PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_weights),
    ("sentence_pieces", sentence_piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: zstandard and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
