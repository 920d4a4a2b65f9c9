"""Quality and toxicity scores by compression (see ``compression``), learned from a bounded sample of labelled rows.

Learning: of each label at most ``per_class`` (times ``common`` for the more frequent one) rows in the order of a hash of
their id go to the driver, and at most ``sample_bytes`` of text of each label; a text that doesn't fit is passed over. Scoring is one pass over whole texts, row by row.

Defined cases: null and empty texts get the score of an empty text's features; null ids count as not held out; labels that
are null or neither 0 nor 1, and labels of documents that don't exist, are ignored; where a class has no labelled row, each
score is the smoothed share of label 1; equal texts score alike; clashing column names give way to the operator's; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, col, with_columns
from .compression import Settings, train

QUALITY = Settings(window=160, dictionary_bytes=12288, min_match=4, lower=False, runs=4, whole=True, cost_one=2.0)
TOXICITY = Settings(window=44, dictionary_bytes=1000, min_match=7, codes=True, min_gain=4.0, chance=0.01, rate_z=6.0, folds=8, cost_zero=8.0)
#: What is learned from: quality needs fewer texts and is dearer to learn.
LEARN = {"quality": {"per_class": 500, "common": 3}, "toxic": {"per_class": 1200, "common": 4}}


class Constant:
    """What stands in for a model where labels of one class are missing."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, texts):
        import numpy as np

        return np.full(len(texts), self.score)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``, as a column."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str, settings: Settings, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1200, common: int = 4, sample_bytes: int = 48 << 20):
    """A model of label 1 against label 0; ``labels`` has the rows that may be learned from."""
    known = labels.select(col(id_col).alias("k"), col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    constant = Constant((n1 + 1) / (n1 + n0 + 2))
    if not n1 or not n0:
        return constant
    take = {1: per_class * (common if n1 > n0 else 1), 0: per_class * (common if n0 >= n1 else 1)}
    order = F.xxhash64("k")
    chosen = known.where("y = 1").orderBy(order, "k").limit(take[1]).unionAll(known.where("y = 0").orderBy(order, "k").limit(take[0]))
    rows = F.broadcast(chosen).join(docs.select(col(id_col).alias("k"), col(text_col).alias("t")), "k")  # at most per_class * (1 + common) ids
    texts, ys, size = [], [], {0: 0, 1: 0}
    for r in rows.orderBy(order, "k", "y").select("y", "t").toLocalIterator():
        t = (r["t"] or "").encode()
        if size[r["y"]] + len(t) > sample_bytes:
            continue
        size[r["y"]] += len(t)
        texts.append(t)
        ys.append(r["y"])
    if not 0 < sum(ys) < len(ys):
        return constant
    return train(texts, ys, settings)


def scored(df: DataFrame, model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score of each row's whole text."""
    schema = with_columns(df.schema, T.StructField(score_col, T.DoubleType()))
    kept = [f.name for f in schema.fields[:-1]]
    at = df.columns.index(text_col)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            values = model.scores(as_bytes(batch.column(at)))
            own = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name in kept}
            yield pa.RecordBatch.from_arrays([*(own[c] for c in kept), pa.array(values, pa.float64())], names=[*kept, score_col])

    return df.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str, settings: Settings, modulus: int, remainder: int) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is 0.5 or more) of every document."""
    model = learn(docs, labels.where(~held_out("doc_id", modulus, remainder)), label_col, settings, **LEARN[label_col])
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; label 1 is good text."""
    return classify(*_tables(spark, sf_dir), "quality", QUALITY, 3, 1)


def op6_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; label 1 is toxic text."""
    return classify(*_tables(spark, sf_dir), "toxic", TOXICITY, 5, 0)
