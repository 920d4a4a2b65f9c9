"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records uniformly into buckets that fit in memory, by a seeded hash of their id and text (of repeated rows,
also of their number among their equals), each bucket to a task of its own. Pass 2 takes each bucket as one array, permutes it by Fisher-Yates (Spark's ``shuffle``) and writes it. Buckets lie end to end, in bucket
order, and the resulting sequence is cut into shards whose row counts differ by one at most; so each task writes to a
few shards only, and the only thing computed over all buckets is a running sum of their counts, one row a bucket.

Rows that agree in id and text could fill a bucket however many there are. They are counted (a count is combined before it
is shuffled), and one row with a count becomes its equals again, in pieces of ``PIECE``, each with a number that is hashed.

Defined cases: null ids and texts are ordinary values; a text larger than a bucket is a bucket's record like any other;
equal texts and repeated rows each keep their own slot; an empty table gives no rows; input columns named like an output column (``shard``, ``slot``) give way to it; other columns are
carried. A column of map type can't be ordered and is refused by Spark's analyser.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, quoted, scratch_path, written

#: The largest bucket's text is about this many bytes.
BUCKET_BYTES = 16 << 20
PIECE = 1024


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` as (v: a row's columns, number: 0, or among rows of one id and text 0, 1, ...)."""
    row = F.struct(*[col(c) for c in df.columns]).alias("v")
    key = [col(id_col).alias("k"), F.xxhash64(col(text_col)).alias("h")]
    again = df.select(*key).groupBy("k", "h").count().where("count > 1")
    if not again.limit(1).count():
        return df.select(row, F.lit(0).cast("long").alias("number"))
    again = written(again.select("k", "h"), "repeated")
    rows = df.select(row, *key)
    same = lambda o: rows["k"].eqNullSafe(o["k"]) & (rows["h"] == o["h"])
    single = rows.join(again, same(again), "left_anti").select("v", F.lit(0).cast("long").alias("number"))
    counted = rows.join(again, same(again), "left_semi").groupBy("v").count()
    pieces = counted.select("v", "count", F.explode(F.expr(f"sequence(0L, count - 1, {PIECE}L)")).alias("first"))
    spread = pieces.repartition("v", "first").select("v", F.explode(F.expr(f"sequence(first, least(count - 1, first + {PIECE - 1}))")).alias("number"))
    return single.unionAll(spread)


def external_shuffle(df: DataFrame, num_shards: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Writes ``df``, shuffled, as Parquet shards (``path/shard=N``) and returns the written table.

    It has the columns of ``df`` with ``slot`` (0, 1, ... in its shard, the reading order) and ``shard``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "shards")
    carried = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 8
    total, rows = df.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    own = lambda c: F.col(f"v.{quoted(c)}")
    scattered = _numbered(df.select(*[col(c) for c in carried]), id_col, text_col).select(
        F.pmod(F.xxhash64(F.lit(seed), own(id_col), own(text_col), "number"), F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(own(id_col).alias("k"), F.xxhash64(own(text_col)).alias("h"), "v").alias("record"),
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # Dealt out by the bucket first, so that the arrays are only built where they stay.
    grouped = scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.shuffle(F.array_sort(F.collect_list("record")), F.lit(seed)).alias("records"))
    small, longer = rows // num_shards, rows % num_shards  # the first `longer` shards have one row more
    edge = longer * (small + 1)
    # One row a bucket, broadcast: left to its estimates, Spark may shuffle the arrays a second time for this join.
    placed = grouped.join(F.broadcast(starts), "bucket").select("first", F.posexplode("records").alias("at", "record"))
    placed = placed.select((F.col("first") + F.col("at")).alias("g"), "record.v")
    placed = placed.withColumn("shard", F.when(F.col("g") < edge, F.floor(F.col("g") / (small + 1))).otherwise(longer + F.floor((F.col("g") - edge) / max(small, 1))).cast("int"))
    placed = placed.select("v.*", (F.col("g") - F.col("shard") * small - F.least(F.col("shard"), F.lit(longer))).alias("slot"), "shard")
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``; the digest columns are computed from the written shards."""
    shards = external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
