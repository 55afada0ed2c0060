"""A corpus pipeline of four stages over ``documents``.

Every stage works on all rows that the one before kept, and its decisions take
effect: documents without a recognised language go, then those that the quality
classifier rejects, then all but one document of each near-duplicate group; what
is left is packed into sequences.  All stages but the last return the columns of
``documents``.

Null, empty and letterless texts go in the first stage.  Repeated rows are near
duplicates of each other, so one stays; of rows that tie, that with the least id.
Rows without an id take part like others.  Very long texts are handled in slices.
Extra columns pass through all stages but the last, whatever their names are.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconfold.llm.common import stored, table
from beaconfold.llm.langid import fit_language_model, recognised
from beaconfold.llm.neardup import NearDupParameters, without_near_duplicates
from beaconfold.llm.packing import cut_documents, pack_pieces
from beaconfold.llm.quality import fit_quality, selected
from beaconfold.llm.queries import graded_ratings, held_out
from beaconfold.llm.tokens import vocabulary_path

LEAST_GRADE = 1  #: grades from here on count as good
NEAR = NearDupParameters(shingle=5, percent=80)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; the model learns from the rows that aren't held out.

    Null and letterless texts go, and so do texts whose value is lower than that
    of nearly all learnt ones, as are those of other languages.
    """
    return recognised(docs, fit_language_model(docs, ~held_out()))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of at least one half of a good grade."""
    model = fit_quality(graded_ratings(table(spark, sf_dir, "labels")), docs)
    return selected(docs, model, LEAST_GRADE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    return without_near_duplicates(docs, NEAR)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    pieces = cut_documents(docs, vocabulary_path())
    return pack_pieces(stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL can't express the models and the greedy packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
