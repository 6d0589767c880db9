"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, language_id, line_dedup, mixing, simhash
from orrery.llm.common import stored, table
from orrery.session import importable


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can't tell go; it is trained on a bounded sample of ``docs`` themselves.

    Null and empty texts have no language and go, null languages aren't trained on; rows are judged one by one, whatever
    their id. Without any labelled text nothing is learned and all stay.
    """
    return language_id.identified_only(docs, language_id.learned(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every line that occurs more than once the first stays, by doc_id; documents without another line go.

    Null ids come first, identical rows share their fate, texts without a line stay as they are.
    """
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays; every pair within the radius counts.

    Null ids and texts without a word take no part and stay; rows of one id stay or go together. The stage works on what
    line deduplication has left: copies whose common lines are gone may no longer be alike.
    """
    return simhash.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the table ``benchmark`` are cut out; documents that are half of such go.

    Null and empty texts are left alone; an empty benchmark changes nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as a schedule of blocks by source, small sources' blocks as often as their share asks for.

    Null sources are one of their own; texts without a token travel with the document that follows; an empty table gives
    an empty schedule.
    """
    return mixing.mixed(docs, max_epochs=None)


STAGES = [
    ("language_id", drop_unidentified),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each result is written before the next stage reads it."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained language model of the first stage and the search for near copies have no SQL.
ORACLE_SQL = None
