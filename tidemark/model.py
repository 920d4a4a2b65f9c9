"""Series and collections: lazy frames with the metadata that slot arithmetic needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
#: Column types by their catalog name, with what fills a missing slot.
TYPES = {"int": ("bigint", 0), "double": ("double", 0.0), "string": ("string", "")}
SHOWN = {"int": "Int", "double": "Double", "string": "String"}
_OF_SPARK = {"bigint": "int", "int": "int", "double": "double", "float": "double", "string": "string"}


class EngineError(Exception):
    """Anything a query can do wrong: unknown names, types that don't fit, series that don't align."""


def type_name(spark_type: str) -> str:
    if spark_type not in _OF_SPARK:
        raise EngineError(f"{spark_type} isn't a column type; int, double and string are")
    return _OF_SPARK[spark_type]


def block_of(row_idx):
    return F.floor(row_idx / BLOCK_ROWS).cast("bigint")


@dataclass(frozen=True)
class Series:
    """A column: ``df`` has row_idx (slot) and value; row k stands for ``start + k * frequency_s``."""

    df: DataFrame
    start: datetime
    frequency_s: int
    dtype: str
    name: str = ""
    column_id: int = 0

    def with_df(self, df: DataFrame, dtype: str | None = None) -> Series:
        return replace(self, df=df, dtype=dtype or self.dtype, name="", column_id=0)

    def timed(self) -> DataFrame:
        """(ts, value), ts computed from the slot."""
        ts = F.expr(f"timestampadd(SECOND, row_idx * {self.frequency_s}, {ntz(self.start)})")
        return self.df.select(ts.alias("ts"), "value")

    def rendered(self) -> DataFrame:
        """(ts, value) with the time as text, as query results are written."""
        return self.timed().select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value")

    def fields(self) -> dict[str, object]:
        return {"name": self.name, "columnId": self.column_id, "columnType": SHOWN[self.dtype]}


@dataclass(frozen=True)
class Collection:
    """A table of columns on one grid of slots; ``df`` has row_idx and the columns."""

    df: DataFrame
    name: str
    table_id: int
    start: datetime
    frequency_s: int
    columns: dict[str, tuple[int, str]]  # name -> (column id, type)
    max_null_s: int | None = None
    length: int | None = None
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def column(self, name: str) -> Series:
        if name not in self.columns:
            raise EngineError(f"{self.name} has no column {name}")
        column_id, dtype = self.columns[name]
        return Series(self.df.select("row_idx", F.col(f"`{name}`").alias("value")), self.start, self.frequency_s, dtype, name, column_id)

    def select(self, *names: str) -> Collection:
        for n in names:
            self.column(n)
        return replace(self, df=self.df.select("row_idx", *[F.col(f"`{n}`") for n in names]), columns={n: self.columns[n] for n in names})

    def fields(self) -> dict[str, object]:
        if self.length is None and "length" not in self._cache:
            self._cache["length"] = (self.df.agg(F.max("row_idx")).first()[0] + 1) if self.df.limit(1).count() else 0
        return {"name": self.name, "tableId": self.table_id, "length": self.length if self.length is not None else self._cache["length"], "startTime": int((self.start - datetime(1970, 1, 1)).total_seconds()), "dataFrequency": self.frequency_s}


def ntz(t: datetime) -> str:
    return f"timestamp_ntz'{t:%Y-%m-%d %H:%M:%S.%f}'"


def at_slot(start: datetime, frequency_s: int, slot: int) -> datetime:
    return start + timedelta(seconds=frequency_s * slot)
