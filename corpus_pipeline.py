"""A training-data pipeline over ``documents``: each stage is written as Parquet and reread by the next.

quality classifier -> fuzzy line dedup -> SimHash near-dedup -> mixing to target weights -> packing
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import common, line_dedup, mixing, packing, quality, simhash
from tollgate.storage import Scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[Scope] = []


def _tidy(stage: Stage) -> Stage:
    """Delete what earlier stages wrote on their way, as their results are written by now; tables that ``docs`` is still made from stay."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = docs.inputFiles() if _LEFT else []
        while _LEFT:
            _LEFT.pop().release(used)
        with Scope(spark) as scope:
            out = stage(spark, docs, sf_dir)
        _LEFT.append(scope)
        return out

    return run


@_tidy
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, predicts as good.

    All columns as they are, repeated rows alike. Null and empty texts are scored by their statistics;
    a null doc_id has no label. No rows give no rows; without labels all score 0.5 and stay.
    """
    return quality.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


@_tidy
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another line of the corpus stands for; documents left without any go.

    Null, empty and white-space texts stay as they are. Of equal lines that of the least doc_id stays,
    a null one first; of rows equal in all columns one keeps lines. No rows give no rows.
    """
    return line_dedup.dedup_lines(docs, drop_empty=True)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component, that of the least doc_id; of ties the first written.

    Null and empty texts are one component; rows without doc_id stay only where no row of theirs has
    one. No rows give no rows.
    """
    return simhash.keep_one(docs)


@_tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their sources' target weights, all columns as they are.

    Copies share a doc_id and differ in nothing else, but for one that the budget cuts short. Documents
    without words go; a null source is a source. Ties in the order are broken by doc_id and text. No
    rows give no rows.
    """
    return mixing.mixed(docs)


@_tidy
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and offsets; null texts are empty.

    ``row`` is a number of the input row's own, which tells apart the copies that mixing makes: (row,
    start) names a piece. No rows give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted classifier and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
