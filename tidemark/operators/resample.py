"""Sampling, time limits, alignment of different grids, correlation, range download."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EngineError, Series, ntz
from ..sources.ingest import _previous
from .maps import joined

HOW = {"avg": F.avg, "last": lambda v: F.max_by(v, "row_idx"), "first": lambda v: F.min_by(v, "row_idx"), "min": F.min, "max": F.max, "sum": F.sum}


def sample(series: Series, every_s: int, how: str = "avg") -> Series:
    """One value for each ``every_s`` seconds (a multiple of the frequency) from the stored rows of that stretch."""
    if every_s <= 0 or every_s % series.frequency_s:
        raise EngineError("the new frequency must be a multiple of the old one")
    if how == "avg" and series.dtype == "string":
        raise EngineError("strings have no average")
    k = every_s // series.frequency_s
    df = series.df.groupBy(F.floor(F.col("row_idx") / k).cast("bigint").alias("slot")).agg(HOW[how](F.col("value")).alias("value"))
    out = series.with_df(df.select(F.col("slot").alias("row_idx"), "value"), "double" if how == "avg" else None)
    return Series(out.df, series.start, every_s, out.dtype)


def take_last(series: Series, span_s: int) -> Series:
    """The rows no older than ``span_s`` before the newest one."""
    top = series.df.agg(F.max("row_idx")).first()[0]
    least = (top if top is not None else 0) - span_s // series.frequency_s
    return series.with_df(series.df.where(F.col("row_idx") >= least))


def upsample(series: Series, frequency_s: int) -> Series:
    """Linear interpolation between stored rows on a finer grid that divides the old one; nothing beyond the ends."""
    if series.dtype == "string" or series.frequency_s % frequency_s:
        raise EngineError("only numbers can be interpolated, on a grid that divides the old one")
    k = series.frequency_s // frequency_s
    pairs = _previous(series.df, carry=("value",)).withColumnsRenamed({"prev": "p", "prev_value": "p_value"})
    slots = pairs.withColumn("slot", F.explode(F.sequence(F.coalesce((F.col("p") * k + 1), F.col("row_idx") * k), F.col("row_idx") * k)))
    share = (F.col("slot") - F.col("p") * k) / ((F.col("row_idx") - F.col("p")) * k)
    value = F.when(F.col("slot") == F.col("row_idx") * k, F.col("value").cast("double")).otherwise(F.col("p_value") + (F.col("value") - F.col("p_value")) * share)
    return Series(slots.select(F.col("slot").cast("bigint").alias("row_idx"), value.alias("value")), series.start, frequency_s, "double")


def align(a: Series, b: Series, frequency_s: int | None = None) -> tuple[Series, Series]:
    """Both series on one grid: finer ones averaged, coarser ones interpolated, slots that one lacks discarded."""
    target = frequency_s or min(a.frequency_s, b.frequency_s)
    if a.start != b.start:
        raise EngineError("series to align must have one start")
    move = lambda s: s if s.frequency_s == target else sample(s, target) if s.frequency_s < target else upsample(s, target)
    x, y = move(a), move(b)
    both = joined([x, y])
    return x.with_df(both.select("row_idx", F.col("v0").alias("value"))), y.with_df(both.select("row_idx", F.col("v1").alias("value")))


def correlation(a: Series, b: Series) -> DataFrame:
    """One row: Pearson's correlation over the common slots."""
    if "string" in (a.dtype, b.dtype):
        raise EngineError("strings have no correlation")
    return joined([a, b]).agg(F.corr("v0", "v1").alias("correlation"))


def download(series: Series, since: datetime, until: datetime, downsample_s: int | None = None) -> DataFrame:
    """(ts, value) with since <= ts < until; with ``downsample_s`` the averages of stretches of that length from ``since`` on."""
    rows = series.timed().where(f"ts >= {ntz(since)} AND ts < {ntz(until)}")
    if downsample_s is None:
        return rows
    stretch = F.floor(F.expr(f"timestampdiff(SECOND, {ntz(since)}, ts)") / downsample_s)
    out = rows.groupBy(stretch.alias("k")).agg(F.avg("value").alias("value"))
    return out.select(F.expr(f"timestampadd(SECOND, k * {downsample_s}, {ntz(since)})").alias("ts"), "value")
