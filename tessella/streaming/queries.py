"""Streaming operators as queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.registry import Tables, query

from . import quotas


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(t: Tables) -> DataFrame:
    d = quotas.windowed_counts(t.events)
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("quota_admission")
def quota_admission(t: Tables) -> DataFrame:
    """What a quota admits of all events, and why not the others: two a minute and four a day a person, one open request, 300 a day in all.

    A purchase ends the request of the same person's event before it. Tests compare it with a plain loop.
    """
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = t.events.withColumn("releases", F.when(F.col("event_type") == "purchase", F.coalesce(before, F.lit(-1))))
    return quotas.admit(d, quotas.Limits(2, 4, 3600.0, 300)).select("user_id", "event_id", "admitted", "reason")
