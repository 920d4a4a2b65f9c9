"""From timestamped rows to slots: bucketing, last write wins, spans and default fill, upserts, JSON rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK_ROWS, TYPES, EngineError, block_of, ntz

CHUNK = 1 << 16


def bucketed(df: DataFrame, ts: str, start: datetime, frequency_s: int) -> DataFrame:
    """``df`` with row_idx; rows before the start are refused (left out)."""
    seconds = F.expr(f"timestampdiff(SECOND, {ntz(start)}, {ts})")
    micros = F.expr(f"timestampdiff(MICROSECOND, {ntz(start)}, {ts})")
    return df.where(micros >= 0).withColumn("row_idx", F.floor(seconds / F.lit(frequency_s)).cast("bigint"))


def last_write_wins(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """One row a slot, the latest one whole (of rows of one time the greatest by its columns); combined before the shuffle."""
    row = F.struct(ts, *columns)
    return df.groupBy("row_idx").agg(F.max(row).alias("_row")).select("row_idx", *[F.col(f"_row.`{c}`") for c in columns])


def _beside(df: DataFrame, step: int, chunk: int, carry: tuple[str, ...], name: str) -> DataFrame:
    """``df`` with ``name``, the row_idx of the row before (step -1) or after (step 1), and ``name``_<c> of that row.

    No task sorts the whole series: rows are windowed in chunks of slots, and a chunk's outermost row takes the nearest slot
    of the chunks beside it, from a table of one row a chunk.
    """
    edge, edge_of = (F.max, F.max_by) if step < 0 else (F.min, F.min_by)
    cut = df.withColumn("_c", F.floor(F.col("row_idx") / chunk).cast("bigint"))
    ends = cut.groupBy("_c").agg(edge("row_idx").alias("_e"), *[edge_of(c, "row_idx").alias(f"_e_{c}") for c in carry])
    order = Window.orderBy("_c")
    ends = ends.select("_c", *[F.lag(c, -step).over(order).alias(f"_far{c}") for c in ["_e", *(f"_e_{c}" for c in carry)]])
    own = Window.partitionBy("_c").orderBy("row_idx")
    near = F.lag("row_idx", -step).over(own)
    found = cut.join(ends, "_c").select(*df.columns, near.alias("_near"), *[F.lag(c, -step).over(own).alias(f"_near_{c}") for c in carry], *[f"_far{c}" for c in ["_e", *(f"_e_{c}" for c in carry)]])
    inside = F.col("_near").isNotNull()
    return found.select(*df.columns, F.coalesce("_near", "_far_e").alias(name), *[F.when(inside, F.col(f"_near_{c}")).otherwise(F.col(f"_far_e_{c}")).alias(f"{name}_{c}") for c in carry])


def _previous(df: DataFrame, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with prev, the row_idx before (null at the first), and prev_<c> of that row for each column of ``carry``."""
    return _beside(df, -1, chunk, carry, "prev")


def _following(df: DataFrame, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with next, the row_idx after (null at the last), and next_<c> of that row for each column of ``carry``."""
    return _beside(df, 1, chunk, carry, "next")


def filled(df: DataFrame, columns: dict[str, str], frequency_s: int, max_null_s: int | None = None, last: int = -1) -> DataFrame:
    """Missing slots take defaults, unless the gap (missing slots times frequency) is longer than ``max_null_s``.

    The slots before the first row, from the one after ``last`` on, count as a gap too. Without a limit every slot from 0 on is filled. A long gap is
    expanded piece by piece of ``BLOCK_ROWS`` slots, so that no row explodes without bound.
    """
    prev = F.coalesce(F.col("prev"), F.lit(last))
    row = F.col("row_idx")
    lo = prev + 1 if max_null_s is None else F.when((row - prev - 1) * frequency_s > max_null_s, row).otherwise(prev + 1)
    pieces = _previous(df).withColumn("_lo", lo).withColumn("_from", F.explode(F.expr(f"sequence(_lo, row_idx, {BLOCK_ROWS}L)")))
    if max_null_s is None:
        pieces = pieces.repartition("_from")  # a gap without limit is spread over tasks
    slots = pieces.withColumn("_slot", F.explode(F.sequence("_from", F.least("row_idx", F.col("_from") + BLOCK_ROWS - 1))))
    here = F.col("_slot") == row
    return slots.select(F.col("_slot").alias("row_idx"), *[F.when(here, F.col(c)).otherwise(F.lit(TYPES[t][1]).cast(TYPES[t][0])).alias(c) for c, t in columns.items()])


def carried(df: DataFrame, column: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``out``, the largest ``column`` up to each row in row_idx order; chunked like ``_previous``."""
    cut = df.withColumn("_c", F.floor(F.col("row_idx") / chunk).cast("bigint"))
    tops = cut.groupBy("_c").agg(F.max(column).alias("_top"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_c", F.max("_top").over(before).alias("_before"))
    own = Window.partitionBy("_c").orderBy("row_idx")
    return cut.join(tops, "_c").withColumn(out, F.greatest(F.max(column).over(own), F.col("_before"))).drop("_c", "_before")


def spans(df: DataFrame) -> DataFrame:
    """(start, end) of the maximal runs of slots, end exclusive."""
    new = F.when(F.col("prev").isNull() | (F.col("row_idx") - F.col("prev") > 1), F.col("row_idx"))
    marked = _previous(df.select("row_idx")).withColumn("_new", new)
    return carried(marked, "_new", "start").groupBy("start").agg((F.max("row_idx") + 1).alias("end"))


def series_frame(df: DataFrame, ts: str, columns: dict[str, str], start: datetime, frequency_s: int, max_null_s: int | None = None) -> DataFrame:
    """Rows with timestamps as a filled slot table: row_idx and the columns."""
    return filled(last_write_wins(bucketed(df, ts, start, frequency_s), ts, list(columns)), columns, frequency_s, max_null_s)


def upsert(base: DataFrame, update: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` with the rows of ``update`` (the last of equal slots in (row_idx, seq) order, if it has seq) written over."""
    if "seq" in update.columns:
        update = last_write_wins(update, "seq", columns)
    u = update.select("row_idx", F.lit(True).alias("_new"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    return base.join(u, "row_idx", "full").select("row_idx", *[F.when(F.col("_new"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def json_cells(df: DataFrame, body: str, columns: dict[str, str]) -> DataFrame:
    """Rows of JSON objects as typed cells; a row with a missing or ill-typed declared column is rejected.

    A number becomes an int by floor; strings are only for string columns, numbers only for the others.
    """
    parsed = F.try_parse_json(F.col(body))
    kind = lambda c: F.schema_of_variant(F.try_variant_get(parsed, f"$['{c}']", "variant"))
    number = lambda c: F.try_variant_get(parsed, f"$['{c}']", "double")
    cells, good = [], []
    for c, t in columns.items():
        if t == "string":
            cells.append(F.try_variant_get(parsed, f"$['{c}']", "string").alias(c))
            good.append(kind(c) == "STRING")
        else:
            exact = F.try_variant_get(parsed, f"$['{c}']", "bigint")
            whole = F.when(kind(c) == "BIGINT", exact).otherwise(F.floor(number(c)))
            cells.append((whole if t == "int" else number(c)).cast(TYPES[t][0]).alias(c))
            good.append(kind(c).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    ok = F.lit(True)
    for g in good:
        ok = ok & F.coalesce(g, F.lit(False))
    rest = [x for x in df.columns if x != body and x not in columns]
    return df.where(ok).select(*rest, *cells)


def with_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block_id", block_of(F.col("row_idx")))


def fetch_rows(df: DataFrame, ranges: list[tuple[int, int]], columns: list[str]) -> DataFrame:
    """Rows of the half-open slot ranges; the predicate is also put on block_id where the table has it, for pruning."""
    cond = F.lit(False)
    for s, e in ranges:
        one = (F.col("row_idx") >= s) & (F.col("row_idx") < e)
        if "block_id" in df.columns:
            one = one & F.col("block_id").between(s // BLOCK_ROWS, max(s, e - 1) // BLOCK_ROWS)
        cond = cond | one
    return df.where(cond).select("row_idx", *columns)


def fetch_exact(df: DataFrame, ranges: list[tuple[int, int]], columns: list[str]) -> DataFrame:
    """(request, row_idx, columns) of the half-open ranges in the order asked for; a column or slot that isn't there is an error."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise EngineError(f"no columns {lacking}")
    row = F.col("row_idx")
    inside = [(row >= s) & (row < e) for s, e in ranges]
    found = fetch_rows(df, ranges, [c for c in df.columns if c != "row_idx"])
    counts = found.agg(*[F.count(F.when(x, 1)).alias(f"n{i}") for i, x in enumerate(inside)]).first() if ranges else []
    if short := [r for r, n in zip(ranges, counts, strict=True) if n != max(0, r[1] - r[0])]:
        raise EngineError(f"not all slots of {short[:3]} are there")
    asked = F.array_compact(F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(inside)])) if ranges else F.array().cast("array<int>")
    return found.select(F.explode(asked).alias("request"), "row_idx", *columns).orderBy("request", "row_idx")


def block_info(df: DataFrame) -> DataFrame:
    """First and last slot and row count of each block."""
    return with_blocks(df).groupBy("block_id").agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.count(F.lit(1)).alias("rows"))
