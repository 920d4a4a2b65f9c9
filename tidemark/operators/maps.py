"""Element-wise maps of one or several series, joined on their slots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import EngineError, Series


def check_aligned(series: list[Series]) -> None:
    """One frequency, and starts within one frequency of the first's."""
    first = series[0]
    for s in series[1:]:
        if s.frequency_s != first.frequency_s or abs((s.start - first.start).total_seconds()) >= first.frequency_s:
            raise EngineError("the series aren't on one grid; align or sample them first")


def joined(series: list[Series]) -> DataFrame:
    """row_idx, v0, v1, ... of the slots that all series have; the first series' start counts."""
    check_aligned(series)
    frames = [s.df.select("row_idx", F.col("value").alias(f"v{i}")) for i, s in enumerate(series)]
    return reduce(lambda a, b: a.join(b, "row_idx"), frames)


def map_series(f: Callable, series: list[Series], dtype: str | None = None) -> Series:
    """``f`` of the values as columns, row by row."""
    if len({s.dtype for s in series}) > 1:
        raise EngineError("series of different types can't be mapped together")
    if len(series) == 1:
        df = series[0].df.select("row_idx", f(F.col("value")).alias("value"))
    else:
        df = joined(series).select("row_idx", f(*[F.col(f"v{i}") for i in range(len(series))]).alias("value"))
    return series[0].with_df(df, dtype)


def _numeric(series: list[Series], what: str) -> None:
    for s in series:
        if s.dtype == "string":
            raise EngineError(f"{what} isn't defined for strings")


def map_sum(*series: Series) -> Series:
    _numeric(list(series), "sum")
    return map_series(lambda *v: reduce(lambda a, b: a + b, v), list(series))


def map_product(*series: Series) -> Series:
    _numeric(list(series), "product")
    return map_series(lambda *v: reduce(lambda a, b: a * b, v), list(series))


def map_difference(a: Series, b: Series) -> Series:
    _numeric([a, b], "difference")
    return map_series(lambda x, y: x - y, [a, b])


def map_quotient(a: Series, b: Series) -> Series:
    """Of integers towards minus infinity, with an error for a divisor of 0; of doubles as IEEE 754 has it."""
    _numeric([a, b], "quotient")
    if a.dtype == "int":
        return map_series(scalars.floor_div, [a, b])
    endless, none = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = lambda x: F.when(x > 0, endless).when(x < 0, -endless).otherwise(none)
    return map_series(lambda x, y: F.when(y == 0, F.when(F.isnan(x), none).otherwise(by_zero(x))).otherwise(x / F.when(y != 0, y)), [a, b])


def kept(series: Series, condition: Callable) -> Series:
    """The rows for which ``condition`` of the value as a column is true."""
    return series.with_df(series.df.where(condition(F.col("value"))))


def _constant(series: Series, c, what: str):
    _numeric([series], what)
    if isinstance(c, bool) or (series.dtype == "int") != isinstance(c, int):
        raise EngineError(f"{what} needs a constant of the series' type")
    return F.lit(c).cast("bigint" if series.dtype == "int" else "double")


def add_constant(series: Series, c: float | int) -> Series:
    k = _constant(series, c, "add")
    return map_series(lambda v: v + k, [series])


def scale(series: Series, c: float | int) -> Series:
    k = _constant(series, c, "scale")
    return map_series(lambda v: v * k, [series])
