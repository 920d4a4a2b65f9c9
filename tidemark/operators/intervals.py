"""Interval maps as frames (start, end, value) of disjoint half-open intervals.

Joins go over bins of ``width``: an interval stands once in each bin it touches, points in one, so that every join is an
equi-join on the bin with the exact condition after it. An interval of more than ``LONG`` bins is binned ``LONG`` times as
wide; what is to meet it has a second copy in such a bin, under a key that only long intervals have on the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import _previous, carried
from ..sources.scratch import written

WIDTH, LONG = 4096, 4096


def _cells(kind: int, first, last, width: int):
    """An array of the bins (kind, bin) of ``width`` from slot ``first`` to slot ``last``."""
    bins = F.sequence(F.floor(first / width).cast("bigint"), F.floor(last / width).cast("bigint"))
    return F.transform(bins, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bin")))


def _binned(df: DataFrame, width: int, short: tuple[int, ...], long: tuple[int, ...]) -> DataFrame:
    """``df`` with kind and bin; kind 0 has narrow bins. ``short`` and ``long``: the kinds for intervals of either sort."""
    first, last = F.col("start"), F.col("end") - 1
    cells = lambda kinds: F.concat(*[_cells(k, first, last, width if k == 0 else width * LONG) for k in kinds])
    cell = F.explode(F.when(F.col("end") - F.col("start") <= width * LONG, cells(short)).otherwise(cells(long))).alias("_cell")
    return df.where("start < end").select("*", cell).select(*df.columns, "_cell.*")


def intersect_join(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """(start, end, left_value, right_value) of all overlaps; a pair counts in the bin of the overlap's start only.

    Kinds of bins: 0 for two short intervals, 1 for a long left one and any right one, 2 for a short left and a long right one.
    """
    a = _binned(left, width, (0, 2), (1,)).select("kind", "bin", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("value").alias("left_value"))
    b = _binned(right, width, (0, 1), (1, 2)).select("kind", "bin", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("value").alias("right_value"))
    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    here = F.floor(start / F.when(F.col("kind") == 0, width).otherwise(width * LONG)) == F.col("bin")
    return a.join(b, ["kind", "bin"]).where((start < end) & here).select(start.alias("start"), end.alias("end"), "left_value", "right_value")


def lookup(points: DataFrame, intervals: DataFrame, key: str = "k", width: int = WIDTH) -> DataFrame:
    """``points`` with left_bound and value of the interval that holds the point; points in none are left out."""
    binned = _binned(intervals, width, (0,), (1,)).select("kind", "bin", F.col("start").alias("left_bound"), "end", "value")
    cell = F.explode(F.concat(_cells(0, F.col(key), F.col(key), width), _cells(1, F.col(key), F.col(key), width * LONG))).alias("_cell")
    at = points.where(F.col(key).isNotNull()).select("*", cell).select(*points.columns, "_cell.*")
    return at.join(binned, ["kind", "bin"]).where((F.col(key) >= F.col("left_bound")) & (F.col(key) < F.col("end"))).drop("kind", "bin", "end")


def overlay(intervals: DataFrame, width: int = WIDTH, merge: bool = True) -> DataFrame:
    """Disjoint intervals from overlapping ones with ``seq``: the highest seq wins; null values cut holes.

    ``merge``: neighbours that touch and have one value become one. The pieces that aren't merged yet are an intermediate
    table, since merging reads them several times.
    """
    ends = intervals.where("start < end").select(F.col("start").alias("row_idx")).union(intervals.where("start < end").select("end")).distinct()
    parts = _previous(ends).where("prev IS NOT NULL").select(F.col("prev").alias("start"), F.col("row_idx").alias("end"), F.col("prev").alias("value"))
    over = intervals.select("start", "end", F.struct("seq", F.struct("value").alias("v")).alias("value"))
    cover = intersect_join(parts, over, width).select("start", "end", "right_value")
    top = cover.groupBy("start", "end").agg(F.max_by("right_value.v.value", "right_value.seq").alias("value")).where("value IS NOT NULL")
    return merged(written(top, "overlay")) if merge else top


def merged(intervals: DataFrame) -> DataFrame:
    """Touching neighbours of one value as one interval."""
    rows = _previous(intervals.select(F.col("start").alias("row_idx"), "end", "value"), carry=("end", "value"))
    same = (F.col("prev_end") == F.col("row_idx")) & F.col("prev_value").eqNullSafe(F.col("value"))
    marked = rows.withColumn("_new", F.when(~F.coalesce(same, F.lit(False)), F.col("row_idx"))).select("row_idx", "end", "value", "_new")
    return carried(marked, "_new", "first").groupBy("first").agg(F.max("end").alias("end"), F.first("value").alias("value")).select(F.col("first").alias("start"), "end", "value")


def insert(base: DataFrame, new: DataFrame, merge: bool = True) -> DataFrame:
    """``base`` with the intervals of ``new`` written over it; of overlapping new ones the later (seq, if any) wins."""
    late = new.select("start", "end", "value", (F.col("seq") + 1 if "seq" in new.columns else F.lit(1)).cast("bigint").alias("seq"))
    return overlay(base.select("start", "end", "value", F.lit(0).cast("bigint").alias("seq")).union(late), merge=merge)


def delete(base: DataFrame, holes: DataFrame) -> DataFrame:
    """``base`` without the ranges of ``holes`` (start, end)."""
    none = F.lit(None).cast(base.schema["value"].dataType)
    return overlay(base.select("start", "end", "value", F.lit(0).alias("seq")).union(holes.select("start", "end", none.alias("value"), F.lit(1).alias("seq"))))


def assocs(intervals: DataFrame) -> DataFrame:
    """(start, end, value) in order."""
    return intervals.orderBy("start")


def keys(intervals: DataFrame) -> DataFrame:
    """(start, end) of what is mapped, in order."""
    return assocs(intervals).select("start", "end")


def elems(intervals: DataFrame) -> DataFrame:
    """The values, in the order of their intervals."""
    return assocs(intervals).select("value")


def is_empty(intervals: DataFrame) -> DataFrame:
    """One row: whether nothing is mapped."""
    return intervals.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def bounds(intervals: DataFrame) -> DataFrame:
    """One row: size, lower, upper."""
    return intervals.agg(F.count(F.lit(1)).alias("size"), F.min("start").alias("lower"), F.max("end").alias("upper"))
