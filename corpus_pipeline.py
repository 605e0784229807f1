"""A training corpus in five stages, from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; the result
is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtrace.llm.mixing import MIX_COLUMNS, mix, shard_rows
from voxtrace.llm.neardup import near_duplicates
from voxtrace.llm.packing import pack, pieces
from voxtrace.llm.substring import REPEAT_COLUMNS, remove_repeats
from voxtrace.llm.textblocks import fresh, set_aside
from voxtrace.llm.toxicity import fit_toxicity, toxicity_score, training_labels
from voxtrace.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, training_labels(labels))
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity_score(model, F.col("text"))).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component at 0.8 similarity of 5-word shingles."""
    classes = near_duplicates(docs, width=5, percent=80)
    others = stage(classes.where(~F.col("kept")).select("doc_id"), "pipeline_others")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 50 words that a smaller id has; texts left empty go."""
    docs, original = set_aside(docs, REPEAT_COLUMNS)
    reduced = remove_repeats(docs)
    changed = F.col("n_removed") > 0
    left = reduced.where(~changed | (F.col("n_removed") < F.col("n_words")))
    left = left.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return original(left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken."""
    docs, original = set_aside(docs, MIX_COLUMNS)
    return original(shard_rows(mix(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2,048 tokens."""
    return pack(pieces(docs, specials=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
