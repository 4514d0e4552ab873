"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Language ID, quality classifier, near duplicates, benchmark decontamination and
SentencePiece encoding. Each stage decides on what its predecessor kept, and the models
of the first two are trained on that, too: languages by the lang column, quality by the
labels that sf_dir holds.

Defined results: null and empty texts have no language and go with the first stage; of
repeated rows and of near copies one row stays, that of the smallest doc_id (null last);
rows that share a doc_id but not their text are judged each for itself; a column of docs
that is called as one of the last stage's own (n_tokens, ids, decoded) is replaced, all
other columns stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, language_id, near_duplicates, quality, sentencepiece_bpe
from granary.llm.common import stored, table

ORACLE_SQL = None
#: Documents under this score go; the threshold of the quality query.
LEAST_QUALITY = quality.THRESHOLD


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case of its own."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, or unlike every learned language, go."""
    found = _unused(docs, "found")
    return language_id.recognised(docs, found).filter(~F.col(found)["rejected"]).select(_columns(docs))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of LEAST_QUALITY at least."""
    trees = quality.train_on_fold(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.scored(F.col("text"), trees) >= LEAST_QUALITY)


def keep_one_of_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, one row of its smallest id. Every row counts for itself, by a number written with it."""
    row = _unused(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("of_row"), "component_id")
    ids = numbered.select(F.col(row).alias("of_row"), F.col("doc_id").alias("id"))
    component = found.join(ids, "of_row").groupBy("component_id")
    several = component.agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "of_row")).alias("first")).filter("n > 1")
    gone = found.join(several, "component_id").filter("of_row <> first.of_row").select(F.col("of_row").alias(row))
    return numbered.join(gone, row, "left_anti").select(_columns(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return docs.filter(F.size(decontaminate.matched(F.col("text"), table(spark, sf_dir, "benchmark"))) == 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens, ids (joined by commas) and decoded."""
    own, coded = ("n_tokens", "ids", "decoded"), _unused(docs, "coded")
    found = docs.withColumn(coded, sentencepiece_bpe.coded(F.col("text"), sentencepiece_bpe.model_path()))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return found.select(*kept, *(F.col(coded)[c].alias(c) for c in own))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
