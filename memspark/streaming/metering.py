"""Incremental metering: cost ledgers over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and tokens per window and phase of events(ts, event_type, props), batch or
    stream; a stream drops events that come later than ``late`` and keeps open windows only."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    phase = F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("phase")
    out = rows.groupBy(F.window("ts", window).alias("w"), phase).agg(F.count("*").alias("calls"), F.sum(F.length(F.coalesce("props", F.lit("")))).alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "phase", "calls", "tokens")
