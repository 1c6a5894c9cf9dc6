"""The corpus pipeline: five operators over ``documents``, one after the other.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), where
docs is what the stage before it kept, and returns a DataFrame. All but the last keep
the columns of documents. ``run`` writes each stage's result to the shared folder and
reads it back for the next one.

Defined results: rows of null id or text pass through every stage by its own rules (a
null text has no language, so it goes in the first); repeated rows count each until
near_dedup keeps one; texts of any length are read whole; other columns are kept by all
stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollsmith.llm.common import id_remainder, release, table, tidy
from rollsmith.llm.language import fit_language_model, keep_identified
from rollsmith.llm.mixing import mixed_rows
from rollsmith.llm.packing import pack_documents
from rollsmith.llm.quality import fit_quality_model, keep_quality
from rollsmith.llm.queries import tokenizer_path
from rollsmith.llm.resemblance import keep_one_alike


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    model = fit_language_model(docs, F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False)))
    return keep_identified(docs, model)


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = fit_quality_model(docs, table(spark, sf_dir, "labels"), F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False)))
    return keep_quality(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word similarity of 0.8 or more."""
    return keep_one_alike(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return pack_documents(docs, tokenizer_path(), added_tokens=True)


STAGES = [("language_id", identify), ("quality", grade), ("near_dedup", deduplicate), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learned models and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Only the table of the result stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        found = tidy(stage)(spark, docs, sf_dir)
        release(docs)
        docs = found
    return docs
