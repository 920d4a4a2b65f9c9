"""Sliding windows over stored rows: the frame is a row and the k - 1 after it, only whole frames count.

No window is ordered over the whole series. Rows get dense positions (a row number in blocks of slots plus the counts of
the blocks before, a table of a row a block); blocks of positions are windowed by themselves, each with a copy of the
first k - 1 rows of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK_ROWS, EngineError, Series
from ..sources.ingest import _following


def positioned(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with pos, the row's number from 0 in row_idx order."""
    cut = df.withColumn("_c", F.floor(F.col("row_idx") / block_rows).cast("bigint"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_c").count().select("_c", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_c").orderBy("row_idx")
    return cut.join(counts, "_c").withColumn("pos", F.col("_before") + F.row_number().over(own) - 1).drop("_c", "_before")


def framed(df: DataFrame, k: int, value, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_idx, value): ``value(window)`` of each whole frame of ``k`` rows."""
    if k < 1:
        raise EngineError("a window has one row at least")
    size = max(block_rows, k)
    rows = positioned(df, block_rows).withColumn("b", F.floor(F.col("pos") / size).cast("bigint"))
    halo = rows.where((F.col("pos") % size < k - 1) & (F.col("b") > 0)).withColumn("b", F.col("b") - 1).withColumn("own", F.lit(False))
    both = rows.withColumn("own", F.lit(True)).unionByName(halo)
    order = Window.partitionBy("b").orderBy("pos")
    frame = order.rowsBetween(0, k - 1)
    out = both.select("row_idx", value(order, frame).alias("value"), F.count(F.lit(1)).over(frame).alias("n"), "own")
    return out.where(F.col("own") & (F.col("n") == k)).select("row_idx", "value")


def collapse(series: Series, op: str, k: int, weights: list | None = None, block_rows: int = BLOCK_ROWS) -> Series:
    """``op`` is sum, product or convolve; the sum of strings is their concatenation."""
    v, text = F.col("value"), series.dtype == "string"
    if text and op != "sum":
        raise EngineError("strings can only be summed in a window")
    if op == "sum":
        value = lambda _, w: F.array_join(F.collect_list(v).over(w), "") if text else F.sum(v).over(w)
    elif op == "product":
        one = F.lit(1).cast("bigint") if series.dtype == "int" else F.lit(1.0)
        value = lambda _, w: F.aggregate(F.collect_list(v).over(w), one, lambda a, x: a * x)
    elif op == "convolve":
        if not weights or any(isinstance(w, bool) or isinstance(w, int) != (series.dtype == "int") for w in weights):
            raise EngineError("the weights must be of the series' type")
        kind = "bigint" if series.dtype == "int" else "double"
        used = list(enumerate(weights))[:k]  # more weights than rows have nothing to weigh

        def value(order, _):
            total = None
            for j, w in used:
                term = F.lit(w).cast(kind) * (F.lead(v, j).over(order) if j else v)
                total = term if total is None else total + term
            return total
    else:
        raise EngineError(f"no window operation {op}")
    return series.with_df(framed(series.df, k, value, block_rows))


def differentiate(series: Series, *, negate: bool = False) -> Series:
    """Each value less the next one (``negate``: the other way round), at the first one's slot."""
    if series.dtype == "string":
        raise EngineError("strings can't be differentiated")
    after = _following(series.df, carry=("value",)).where("next IS NOT NULL")
    here, there = F.col("value"), F.col("next_value")
    return series.with_df(after.select("row_idx", (there - here if negate else here - there).alias("value")))
