"""The presence matrix of a stream: bit masks of systems by column, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masks(events: DataFrame, col: str, system: str, *, time: str | None = None, watermark: str = "10 minutes", window: str | None = None) -> DataFrame:
    """(col[, window], mask): bit k is set if system k (0 to 62) was seen in the column; for streams and tables alike.

    With ``time`` and ``window`` masks are kept by window and late events beyond ``watermark`` are dropped.
    """
    bit = F.expr(f"shiftleft(1L, cast({system} AS int))")
    if time is None:
        return events.groupBy(col).agg(F.bit_or(bit).alias("mask"))
    late = events.withWatermark(time, watermark) if events.isStreaming else events
    return late.groupBy(F.window(time, window or "1 hour"), col).agg(F.bit_or(bit).alias("mask"))
