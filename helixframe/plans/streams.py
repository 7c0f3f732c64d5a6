"""Streaming operators; a query runs its stream over the table once, then returns the rows."""

from __future__ import annotations

import uuid

from helixframe.plans import data as D
from helixframe.plans.registry import query
from helixframe.session import shared_folder
from helixframe.streaming.quality import collected_windows, windowed_metrics


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_quality_windows(spark, sf_dir):
    """Update mode lets the watermark drop closed windows from the state; a batch writes the windows that it changed to a
    folder of its own, so a repeated batch replaces what it wrote, and the last version of each window counts."""
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = D.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return D.rounded(collected_windows(windowed_metrics(stream), at), "total", digits=2)
