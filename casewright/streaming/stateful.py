"""Deadline alerts that remember the last notice, as a stateful stream and as the batch job that it equals.

Events (key, owner, due, open, ts) tell how a case stands from then on. At each midnight an open, owned case that is due
within some days, or overdue, gets one alert. The stream keeps for each open case its deadline, its owner and the day of
its last notice; event time alone decides, so a replay or a restart repeats nothing and skips nothing. Days are those of
a session in UTC.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.columns import unused

#: The days before a deadline that have a text of their own; the last one stands for all others.
CASE_THRESHOLDS = [(0, "vence hoy o vencida"), (1, "vence mañana"), (3, "vence en 3 días")]
EPOCH = date(1970, 1, 1)


def daily_alerts(events: DataFrame, last: str, days: int = 3, thresholds: list[tuple[int, str]] = CASE_THRESHOLDS) -> DataFrame:
    """(key, owner, day, days, alert) for every day up to `last` from a table of events (key, owner, due, open, ts).

    An event holds from its own moment to the next one of its key; of events at one moment the one that sorts last
    (open before closed, then by owner and deadline) holds. Rows with a null key or moment tell nothing.
    """
    row, until = unused(events, "row", "until")
    known = events.where("key is not null and ts is not null").groupBy("key", "ts").agg(F.max(F.struct((~F.col("open")).alias("closed"), "owner", "due")).alias(row))
    spans = known.withColumn(until, F.lead("ts").over(Window.partitionBy("key").orderBy("ts")))
    midnight = lambda t: F.date_add(F.to_date(t), F.when(F.date_trunc("day", t) == F.col(t), 0).otherwise(1))  # noqa: E731  the first midnight at or after t
    first = F.greatest(midnight("ts"), F.date_sub(f"{row}.due", days))
    end = F.least(F.date_sub(midnight(until), 1), F.lit(last).cast("date"))
    live = spans.where(f"not {row}.closed and {row}.owner is not null and {row}.due is not null").withColumns({"first": first, "end": end}).where("first <= end")
    each = live.select("key", f"{row}.owner", f"{row}.due", F.explode(F.sequence("first", "end")).alias("day"))
    return _worded(each.select("key", "owner", "day", F.datediff("due", "day").alias("days")), thresholds)


def _worded(alerts: DataFrame, thresholds: list[tuple[int, str]]) -> DataFrame:
    text = F.coalesce(*(F.when(F.greatest("days", F.lit(0)) == d, t) for d, t in thresholds[:-1]), F.lit(thresholds[-1][1]))
    return alerts.select("key", "owner", "day", "days", text.alias("alert"))


STATE = "owner long, due int, open boolean, noticed int, pending string"
OUT = "key long, owner long, day date, days int"


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _midnights(since: int, until: int) -> tuple[int, int]:
    """The days whose midnight lies in [since, until), in microseconds: first day and the day after the last."""
    day = 86_400_000_000
    return -(-since // day), -(-until // day)


def _advance(key: int, known: tuple, since: int | None, until: int, days: int) -> tuple[list[tuple], int]:
    """Alerts of a case that stands as `known` from one moment to another, and the day of its last notice."""
    owner, due, open_, noticed = known
    if since is None or not open_ or owner is None or due is None:
        return [], noticed
    first, end = _midnights(since, until)
    told = range(max(first, due - days, noticed + 1), end)
    return [(key, owner, EPOCH + timedelta(days=d), due - d) for d in told], told[-1] if told else noticed


def _notify(key: tuple, batches: Iterable[pd.DataFrame], state, days: int) -> Iterator[pd.DataFrame]:
    """Applies the events that the watermark has passed, in their order, and tells each midnight once."""
    owner, due, open_, noticed, pending = state.get if state.exists else (None, None, False, -(10**6), '{"since": null, "events": []}')
    kept = json.loads(pending)
    events = [tuple(e) for e in kept["events"]]
    for batch in batches:
        for ts, o, d, is_open in zip(batch["ts"], batch["owner"], batch["due"], batch["open"]):
            if pd.isna(ts) or pd.isna(is_open):
                continue
            events.append((_micros(ts), not is_open, None if pd.isna(o) else int(o), None if pd.isna(d) else (d - EPOCH).days))
    now = state.getCurrentWatermarkMs() * 1000
    less = lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3] is not None, e[3] or 0)  # noqa: E731  nulls first, as in the batch job
    events.sort(key=less)
    out, since = [], kept["since"]
    while events and events[0][0] < now:
        ts, closed, o, d = events.pop(0)
        if events and events[0][0] == ts:
            continue  # of events at one moment the last one holds
        if since is not None and ts < since:
            continue  # later than the watermark allows: what it would have changed is told already
        told, noticed = _advance(key[0], (owner, due, open_, noticed), since, ts, days)
        out += told
        owner, due, open_, since = o, d, not closed, ts
    told, noticed = _advance(key[0], (owner, due, open_, noticed), since, now, days)
    out += told
    since = max(since, now) if since is not None else None
    if open_ or events:
        state.update((owner, due, open_, noticed, json.dumps({"since": since, "events": events})))
        # wake at the next midnight, or when the next waiting event is passed
        wake = (now // 86_400_000_000 + 1) * 86_400_000
        if events:
            wake = min(wake, events[0][0] // 1000 + 1)
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["key", "owner", "day", "days"])


def alerts_with_memory(events: DataFrame, delay: str = "1 day", days: int = 3, thresholds: list[tuple[int, str]] = CASE_THRESHOLDS) -> DataFrame:
    """The stream of alerts from a stream of events (key, owner, due, open, ts): append mode, one alert a key and day.

    Events may come in any order within `delay`; a case's state goes when it is closed. Its results equal `daily_alerts`
    for all days that the watermark has passed.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    known = events.where("key is not null").select(F.col("key").cast("long"), F.col("owner").cast("long"), "due", "open", "ts").withWatermark("ts", delay)

    def run(key, batches, state):
        return _notify(key, batches, state, days)

    return _worded(known.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout), thresholds)
