"""From raw documents to a training mixture, stage by stage.

Each stage is written as Parquet and read again as the documents of the next; all but the last
return the columns of ``documents``. Stages: documents in no known language go; one document of
each group of near copies stays; documents that hold benchmark items go; personal data are
replaced by marks; sources are mixed to target weights.

The last stage returns a row for each time a document is taken, with the columns of ``documents``
and a struct ``mixing`` (n_tokens, weight, pass, block_key, doc_key): sorted by pass, block_key and
doc_key these rows are the training corpus.

Edge cases: stages work on rows. A repeated doc_id is no repeated document: rows with other texts
stay, and of equal or nearly equal texts one row stays, whatever its id. Null ids are carried
along. Null and empty texts have no language and go in the first stage; a null lang is filled,
a null source is a source of its own. Extra columns are carried, whatever their names. Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import decontamination, language_id, mixing, near_dedup, pii
from sextant.llm.common import keep, table


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns in one, so that no name meets an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from ``row``, some of them replaced."""
    return df.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in no learned language go; a missing lang is filled with the predicted one."""
    model = language_id.sample(docs)
    judged = language_id.identify(packed(docs), model, ["row"]).where(language_id.in_known_language(language_id.limits(model)))
    return unpacked(judged, docs, lang=F.coalesce("row.lang", "lang_pred"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that with the least doc_id."""
    return near_dedup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by [KIND]; n_chars follows the text."""
    found = pii.find(packed(docs), ["row"])
    text = pii.redact(F.col("row.text"), F.col("found"))
    n_chars = F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs, text=text, n_chars=n_chars)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, sources repeated to their weights."""
    return mixing.corpus(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixture),
]

#: No SQL: MinHash components, BM25 search and trained models are beyond it; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
