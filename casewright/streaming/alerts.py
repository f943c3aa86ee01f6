"""Deadline alerts and event trends, as batch jobs and as Structured Streaming queries with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.columns import due_days


def deadline_alerts(cases: DataFrame, as_of: str, days: int = 3, closed: tuple[str, ...] = ("Respondida",)) -> DataFrame:
    """One alert for each active, owned, open case that is due within `days` or overdue."""
    left = cases.where(F.col("is_active") & F.col("owner_id").isNotNull() & ~F.col("state").isin(*closed)).withColumn("days", due_days("due", as_of))
    text = F.when(F.col("days") <= 0, "vence hoy o vencida").when(F.col("days") == 1, "vence mañana").otherwise("vence pronto")
    return left.where(F.col("days") <= days).select("case_id", "owner_id", "days", text.alias("alert"))


#: The days before a deadline that have a text of their own, for files and payments; the last one stands for all others.
FILE_THRESHOLDS = [(0, "vence hoy o vencida"), (1, "vence mañana"), (3, "vence en 3 días"), (5, "vence en 5 días")]


def threshold_alerts(df: DataFrame, key: str, as_of: str, thresholds: list[tuple[int, str]], closed: list[str]) -> DataFrame:
    """(id, owner_id, days, alert) of active, owned, open rows that are due within the last threshold or overdue."""
    days = due_days("due", as_of)
    text = F.coalesce(*(F.when(F.greatest("days", F.lit(0)) == d, t) for d, t in thresholds[:-1]), F.lit(thresholds[-1][1]))
    left = df.where(F.col("is_active") & F.col("owner_id").isNotNull() & ~F.col("state").isin(closed)).withColumn("days", days)
    return left.where(F.col("days") <= thresholds[-1][0]).select(F.col(key).alias("id"), "owner_id", "days", text.alias("alert"))


def alerts_stream(events: DataFrame, key: str, ts: str, delay: str = "2 days") -> DataFrame:
    """At most one row a key and day; state goes once the watermark has passed it."""
    return events.withWatermark(ts, delay).withColumn("day", F.to_date(ts)).dropDuplicatesWithinWatermark([key, "day"])


def latest_state_stream(events: DataFrame, key: str, state: str, ts: str, idle: str | None = None, delay: str = "2 days") -> DataFrame:
    """Current state of each key from a transition log.

    With `idle`, keys without an event for that long are written out (append mode) and their state goes once the
    watermark has passed; without it the state of every key stays (batch, update or complete mode).
    """
    if idle is None:
        return events.groupBy(key).agg(F.max_by(state, ts).alias("state"), F.max(ts).alias("since"))
    sessions = events.withWatermark(ts, delay).groupBy(F.session_window(ts, idle), key)
    return sessions.agg(F.max_by(state, ts).alias("state"), F.max(ts).alias("since")).select(key, "state", "since")


def trend_stream(events: DataFrame, ts: str, kind: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are dropped."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")
