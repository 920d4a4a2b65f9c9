"""Scalar functions on columns with the query language's semantics."""

from __future__ import annotations

from pyspark.sql import functions as F


def floor_div(a, b):
    """Division of integers towards minus infinity; Spark's truncates."""
    r = a % b
    return F.call_function("div", a, b) - F.when((r != 0) & ((r < 0) != (b < 0)), 1).otherwise(0)


def int_pow(a, b):
    """Exact integer power; a negative exponent raises."""
    ones = F.when(b > 0, F.array_repeat(a, b.cast("int"))).otherwise(F.array().cast("array<bigint>"))
    value = F.aggregate(ones, F.lit(1).cast("bigint"), lambda x, y: x * y)
    return F.when(b < 0, F.raise_error(F.lit("Negative exponent")).cast("bigint")).otherwise(value)


def repeat(text, n):
    """Repetition; nothing for n of 0 or less."""
    return F.repeat(text, n.cast("int"))


def concat(a, b):
    return F.concat(a, b)
