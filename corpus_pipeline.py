"""From raw documents to sharded training data: five stages, each one of the operators of apexframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it back as the next stage's docs. All stages but the last return the columns of documents. A null or empty text
passes every stage (it is no copy of anything, holds no benchmark item and scores like an empty window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.llm.common import materialize, table
from apexframe.llm.decontaminate import drop_leaking
from apexframe.llm.mixing import mix, repeat_rows
from apexframe.llm.parity_join import BROADCAST_ROWS, similarity_classes
from apexframe.llm.sharding import assign, build_tree, with_slots
from apexframe.llm.toxicity import drop_toxic

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest doc_id.

    Rows count, not ids: a row goes by its own text, so rows with a null or repeated doc_id take no others with them, and of
    equal rows with one id one stays. A null id comes after all others. docs is read more than once and has to give its
    rows in the same order each time, as a table does.
    """
    rows = docs.withColumn("_ax_row", F.monotonically_increasing_id())
    ident = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("_ax_row").alias("row"))
    classes = similarity_classes(rows.select(ident.alias("doc_id"), "text"), 5, 80, 100)
    others = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id.row").alias("_ax_other")), "pipeline-copies")
    if others.count() <= BROADCAST_ROWS:  # of 8 bytes
        others = F.broadcast(others)
    return rows.join(others, F.col("_ax_row") == F.col("_ax_other"), "left_anti").drop("_ax_row")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once, or up to three times."""
    return repeat_rows(mix(docs)).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; the repetitions of a document share its shard."""
    return with_slots(assign(docs, build_tree(SHARDS)), ["doc_id", "source", "n_chars"])


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", sharding),
]

ORACLE_SQL = None  # a trained network and SimHash search have no SQL form; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
