"""From raw documents to an encoded training corpus.

Five stages, each calling one operator of ``vitalspark.llm``: toxic documents
go, poor ones go, one document of each near-duplicate group stays, documents
that hold a benchmark item go, the rest is encoded.  Every stage's result is
written to the shared folder and read again by the next, so that a lost
executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm import pu_quality, sp_viterbi, string_kernel, superminhash, template_leaks
from vitalspark.llm.common import shared_path, table
from vitalspark.llm.queries import GOOD, TOXIC, vocabulary


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not use."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability is below the threshold."""
    model = string_kernel.fit(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "toxicity")
    return string_kernel.scored(docs, model, into=score).where(F.col(score) < TOXIC).drop(score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = pu_quality.fit(pu_quality.featured(docs), table(spark, sf_dir, "labels"))
    score = _free(docs, "quality_score")
    return pu_quality.scored(docs, model, into=score).where(F.col(score) >= GOOD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return superminhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return template_leaks.clean(docs, template_leaks.matches(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids, their number, and whether they
    spell the text again."""
    rows = sp_viterbi.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("encode", encode)]

# Model fits, connected components and Viterbi paths are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
