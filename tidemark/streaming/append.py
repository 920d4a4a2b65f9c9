"""The append path as Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..model import ntz
from ..sources.catalog import Catalog


def append_stream(catalog: Catalog, name: str, rows: DataFrame, checkpoint: str, ts: str = "ts") -> DataStreamWriter:
    """Writes each micro-batch into a collection: slots, last write wins, fill, upsert of the touched blocks.

    A batch that runs again after a failure writes the same rows over themselves. Rows for a closed null span are left out.
    """

    def write(batch: DataFrame, _: int) -> None:
        catalog.append(name, batch, ts)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tumbling_last(rows: DataFrame, ts: str, columns: list[str], start: datetime, frequency_s: int, delay: str = "10 minutes") -> DataFrame:
    """(row_idx, columns): each slot's last values, final once the watermark has passed the slot; late rows are dropped."""
    offset = int((start - datetime(1970, 1, 1)).total_seconds()) % frequency_s
    slot = F.window(ts, f"{frequency_s} seconds", startTime=f"{offset} seconds")
    last = rows.withWatermark(ts, delay).groupBy(slot).agg(*[F.max_by(c, F.struct(ts, *columns)).alias(c) for c in columns])
    idx = F.expr(f"timestampdiff(SECOND, {ntz(start)}, window.start)") / F.lit(frequency_s)
    return last.select(F.floor(idx).cast("bigint").alias("row_idx"), *columns)


def session_spans(rows: DataFrame, ts: str, gap_s: int, delay: str = "10 minutes") -> DataFrame:
    """(start, end, rows) of the stretches of rows with no gap of ``gap_s`` seconds or more between them."""
    s = F.session_window(ts, f"{gap_s} seconds")
    return rows.withWatermark(ts, delay).groupBy(s).count().select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("rows"))
