"""A reader of stored block files: JSON with the values gzipped, in base64, as a store of the older kind leaves them.

A folder has a file ``blk_<table>_<column>_<block>`` for each block (tableId, columnId, blockId, startRow, endRow, type,
data) and a file ``tables``, a list of [table, column, block] that says which of them count. ``data`` is, before gzip and
base64, a list: the number of values as 8 bytes, then the values; all numbers are big-endian. An int has 8 bytes. A double is
its mantissa (a byte 0 and 4 bytes; or a byte 1, a byte of its sign, and a list of bytes, the lowest first) and its binary
exponent, 8 bytes. A text is a list of UTF-8 characters.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = 16_384
_FILE = "tableId bigint, columnId bigint, blockId bigint, startRow bigint, endRow bigint, type string, data string"
SCHEMA = "table_id bigint, column_id bigint, block_id bigint, type string, row bigint, int_value bigint, double_value double, string_value string"


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, size: int = 8, signed: bool = True) -> int:
        self.at += size
        if self.at > len(self.data):
            raise ValueError("a block's data end too early")
        return int.from_bytes(self.data[self.at - size : self.at], "big", signed=signed)

    def double(self) -> float:
        if self.number(1):
            sign = self.number(1, True)
            n = self.number()
            self.at += n
            mantissa = sign * int.from_bytes(self.data[self.at - n : self.at], "little")
        else:
            mantissa = self.number(4)
        exponent = self.number()
        try:
            return math.ldexp(mantissa, exponent)
        except OverflowError:
            return math.copysign(math.inf, mantissa)

    def text(self) -> str:
        begin = None
        for _ in range(self.number()):
            begin = self.at if begin is None else begin
            lead = self.number(1, False)
            self.at += 0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
        return "" if begin is None else self.data[begin : self.at].decode()


def values(data: bytes, kind: str):
    """The values of a block's gzipped data, one by one."""
    own = _Bytes(zlib.decompress(data, 31))
    read = {"int": own.number, "double": own.double, "string": own.text}[kind]
    for _ in range(own.number()):
        yield read()


def read_block_files(spark: SparkSession, folder: str) -> DataFrame:
    """(table_id, column_id, block_id, type, row, int_value, double_value, string_value) of all blocks that count.

    ``row`` is the storage row; of the three values the one of the column's type is set. A task reads a block at a time and
    gives its values in batches.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="blk_*")
    block = files.select(F.from_json("value", _FILE).alias("b")).select("b.*")
    listed = spark.read.text(folder, wholetext=True, pathGlobFilter="tables")
    named = listed.select(F.explode(F.from_json("value", "array<array<bigint>>")).alias("t"))
    named = named.select(F.col("t")[0].alias("tableId"), F.col("t")[1].alias("columnId"), F.col("t")[2].alias("blockId")).distinct()
    counted = block.join(named, ["tableId", "columnId", "blockId"], "left_semi").select("tableId", "columnId", "blockId", "type", "startRow", F.unbase64("data").alias("data"))

    def rows(batches):
        import pyarrow as pa

        kinds = {"int": pa.int64(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            for table, column, number, kind, row, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, every = [], values(data, kind)
                while True:
                    held = [v for _, v in zip(range(_ROWS), every)]
                    if not held:
                        break
                    n = len(held)
                    same = lambda v, t: pa.array([v] * n, t)  # noqa: B023, E731
                    cells = [pa.array(held, t) if k == kind else pa.nulls(n, t) for k, t in kinds.items()]
                    yield pa.RecordBatch.from_arrays([same(table, pa.int64()), same(column, pa.int64()), same(number, pa.int64()), same(kind, pa.string()), pa.array(range(row, row + n), pa.int64()), *cells], names=["table_id", "column_id", "block_id", "type", "row", "int_value", "double_value", "string_value"])
                    row += n

    return counted.mapInArrow(rows, SCHEMA)


def slotted(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with row_idx, by ``spans``: (table_id, column_id, start, end, base), a span of slots and its first storage row."""
    inside = (F.col("row") >= F.col("base")) & (F.col("row") < F.col("base") + F.col("end") - F.col("start"))
    return rows.join(spans, ["table_id", "column_id"]).where(inside).withColumn("row_idx", F.col("start") + F.col("row") - F.col("base")).drop("start", "end", "base")
