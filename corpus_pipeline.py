"""The training-data pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of ``documents``, others that the table has included, whatever their names.

Defined cases: rows with a null id can't be grouped, so near duplicates leave them; rows that share an id but not a text are
documents of their own; of rows that agree in both, one stays; null and empty texts are judged like any text and never
duplicates; very long texts are judged whole; scores just at ``REJECT`` are toxic, and good; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.classify import LEARN, QUALITY, TOXICITY, held_out, learn, scored
from tidemark.llm.common import free_name, written
from tidemark.llm.decontaminate import leaks
from tidemark.llm.near_dup import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.tokens import tokenizer_path
from tidemark.sources.scratch import mark, release

REJECT = 0.5
#: Near duplicates share this percentage of their five-word shingles, or more.
SIMILAR = 80


def _labels(spark: SparkSession, sf_dir: str, modulus: int, remainder: int) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", modulus, remainder))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECT``."""
    name = free_name(docs, "score")
    model = learn(docs, _labels(spark, sf_dir, 5, 0), "toxic", TOXICITY, **LEARN["toxic"])
    return scored(docs, model, score_col=name).where(F.col(name) < REJECT).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score isn't below ``REJECT``."""
    name = free_name(docs, "score")
    model = learn(docs, _labels(spark, sf_dir, 3, 1), "quality", QUALITY, **LEARN["quality"])
    return scored(docs, model, score_col=name).where(F.col(name) >= REJECT).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return one_of_each(docs, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = leaks(docs.select(F.struct("*").alias("doc"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of its own."""
    pieces = pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dup", near_dup), ("decontamination", decontamination), ("packing", packing)]
#: The stages learn, hash and tokenize, which SQL can't express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            release(spark, since, keep=(f"stage-{name}",))  # the stage's input and what its operator wrote on its way
    return docs
