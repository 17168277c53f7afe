"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming import ingest


def stream_once(s: SparkSession, d: str) -> DataFrame:
    """Every event once, counted per kind, by a stream that drops repeats."""
    e = ingest.once(ingest.event_stream(s, d, "events.parquet"), "event_id", "ts", "60 days")
    return ingest.run_to_table(e.select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Daily windows per kind, in complete mode."""
    e = ingest.settled_counts(ingest.event_stream(s, d, "events.parquet"), "ts", "1 day", "90 days", "event_type")
    out = ingest.run_to_memory(e, f"win_{uuid.uuid4().hex}", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"stream_once": stream_once, "stream_windows": stream_windows}
SQL = {
    "stream_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
