"""Streaming twins of batch operators: windows of events, sessions of equal labels, and a guarded catalog append."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from cohortgeo.sources.store import append_catalog, read_catalog


def chunk_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "4 seconds", stride: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """X25 on a stream: counts and sums by sliding window; a row later than the watermark is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, stride), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def label_sessions(events: DataFrame, ts: str = "ts", sequence: str = "user_id", label: str = "event_type", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of one label in a sequence, ended by a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), sequence, label).agg(F.count("*").alias("n"))


def guarded_catalog(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """K5 on a stream: each batch is appended whole or, at a conflict, fails the query. Rows that were written before a restart are
    there already, the same in all columns, and are left out."""

    def put(batch: DataFrame, _: int) -> None:
        known = read_catalog(batch.sparkSession, path)
        fresh = batch.join(known, [batch[c].eqNullSafe(known[c]) for c in known.columns], "left_anti")
        if not fresh.isEmpty():
            append_catalog(batch.sparkSession, path, fresh)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
