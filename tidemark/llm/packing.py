"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths together, no sequence across documents.

A document of n ids is cut into n div max_len pieces of max_len and one piece for each set bit of the rest, longest
first. Every piece is a sequence by itself: its length is a power of two, so it needs no padding, and sequences of one
length lie together (a contiguous run of sequence ids a length, and one run of rows of a length in each written file, which
Parquet's statistics skip or find), ready for batches of equal shape. A task writes one file; no token is shuffled.

Defined cases: a null or empty text is the end id alone, one piece of length 1; a very long text is cut like any other;
equal texts and repeated rows are packed each for itself; null ids are carried; an empty table gives no pieces; only the id
and the text are read, whatever else the table has and whatever its columns' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, written
from .tokens import encoder, in_parts, tokenizer_path

#: Rows (a task and length each) of the table of first sequence ids that may be broadcast; a larger one is joined by shuffling.
BROADCAST_RUNS = 1_000_000
SCHEMA = "doc_id long, start long, doc_tokens long, ids binary, task int, nth long, length int"


def binary_lengths(n: int, max_len: int) -> list[int]:
    """``max_len`` (a power of two) as often as it goes, then the powers of two of what is left, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, *, tokenizer: str, end_id: int, max_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written pieces: doc_id, start, length, ids (little-endian, 4 bytes each), doc_tokens, sequence_id, offset.

    Pieces are numbered in each task and length as they are made; a sequence id adds the number of sequences before that
    task's, from a table of a row a task and length.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), {}
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in in_parts([x or "" for x in batch.column(1).to_pylist()]):
                doc, start, total, piece, nth, length = [], [], [], [], [], []
                for raw in encode(texts):
                    raw += end
                    n, pos = len(raw) // 4, 0
                    for size in binary_lengths(n, max_len):
                        doc.append(ids[at])
                        start.append(pos)
                        total.append(n)
                        piece.append(raw[4 * pos : 4 * (pos + size)])
                        nth.append(made.setdefault(size, 0))
                        length.append(size)
                        made[size] += 1
                        pos += size
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(piece, pa.binary()), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64()), pa.array(length, pa.int32())], names=["doc_id", "start", "doc_tokens", "ids", "task", "nth", "length"])

    cuts = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(cut, SCHEMA)
    pieces = written(cuts.sortWithinPartitions(F.desc("length"), "nth"), "pieces")
    runs = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task and length
    first = runs.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = written(first, "first-sequences")
    placed = pieces.join(F.broadcast(first) if first.count() <= BROADCAST_RUNS else first, ["length", "task"])
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 ids; a row a piece, with the checksum of the ids read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
