"""A training corpus from raw documents: five stages, each on all that the one before has kept.

    toxicity                 documents whose score is 0.5 or more go
    n-gram Jaccard join      of each group of near copies (five words, 0.8) the smallest id stays
    substring dedup          later copies of passages are cut; documents that only repeat go
    benchmark decontamination  documents that hold a benchmark window go
    packing                  what is left becomes sequences of power-of-two length

``run`` writes every stage's result to the shared folder and reads it again, so that a lost executor costs
one stage's tasks at most. An empty table gives an empty one at every stage; further columns, whatever their names,
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotwise.llm.cluster import small_batches, written
from plotwise.llm.decontamination import decontaminate
from plotwise.llm.near_copies import near_copies
from plotwise.llm.packing import pack_powers_of_two
from plotwise.llm.queries import vocabulary
from plotwise.llm.substrings import without_repeats
from plotwise.llm.toxicity import drop_toxic, train


def _bounded(stage):
    """A stage whose Arrow batches are small: five operators in turn share the workers' memory."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@_bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic; the machine learns from the labelled documents among those given. Null and empty texts, null ids and repeated rows are scored like any other."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_bounded
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near copies, all its rows; rows without an id, a text or a word stay."""
    dropped = written(near_copies(docs, n=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


@_bounded
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of passages; a document of which nothing is left goes. n_chars, where it is a column, follows the text."""
    return without_repeats(docs)


@_bounded
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten consecutive words of a benchmark item occur; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, remove="documents")


@_bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of binary length, at most 2048 tokens; a null or empty text is the end id alone."""
    return pack_powers_of_two(docs, vocabulary(), end_id=1, longest=2048)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL has no string-kernel machine, so no statement gives run()'s rows; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
