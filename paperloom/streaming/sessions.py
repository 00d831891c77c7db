"""Session accounting on a stream of requests (user_id, ts, cost, entities)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import Settings

HOUR_S = 3600


def sliding_counts(requests: DataFrame, late: str = "10 minutes", limit: int = Settings.requests_per_hour, days: int = Settings.session_days) -> DataFrame:
    """requests with n_before and admitted, counted within the hour before each request; works on streams only.

    A user's state is the requests of the last hour, and it is dropped `days` after the last of them in event time. A request
    that is older than the watermark is dropped by the engine; within a batch requests count in the order of time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        micros = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
        # Requests of one moment do not count for each other, as in the batch form.
        ordered, hour = sorted(recent + micros), HOUR_S * 1_000_000
        before = [bisect_left(ordered, t) - bisect_right(ordered, t - hour) for t in micros]
        last = ordered[-1]
        kept = ordered[bisect_right(ordered, last - hour) :]
        state.update((kept,))
        state.setTimeoutTimestamp(max(last // 1000 + days * 24 * HOUR_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"].to_numpy(), "n_before": before, "admitted": [n < limit for n in before]})

    watched = requests.withWatermark("ts", late).select("user_id", "ts")
    return watched.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, ts timestamp, n_before long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def hourly_totals(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(start, user_id, requests, cost, entities) of each hour, emitted once the watermark has passed it."""
    hours = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "user_id")
    return hours.agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.sum("entities").alias("entities")).select(F.col("window.start").alias("start"), "user_id", "requests", "cost", "entities")


def busy_flags(events: DataFrame, late: str = "10 minutes", expire_minutes: int = 60) -> DataFrame:
    """(user_id, ts, accepted) of start events of a stream (user_id, ts, event: start or finish).

    A user has one job at a time: a start while one is running is refused, and a refused start never frees the running
    one. A job that never finishes is forgotten `expire_minutes` after it began, in event time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began = state.get[0] if state.exists else None
        limit = expire_minutes * 60_000_000
        # A job that ends at a moment makes room for one that begins then.
        rows = pd.concat(list(batches)).sort_values(["ts", "event"], kind="stable")
        out = []
        for ts, micros, event in zip(rows["ts"], rows["ts"].astype("datetime64[us]").astype("int64"), rows["event"]):
            running = began is not None and micros < began + limit
            if event == "finish":
                began = None
            elif event == "start":
                out.append((ts, not running))
                began = began if running else micros
        if began is None:
            if state.exists:
                state.remove()
        else:
            state.update((began,))
            state.setTimeoutTimestamp(max((began + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "ts": [o[0] for o in out], "accepted": [o[1] for o in out]})

    watched = events.withWatermark("ts", late).select("user_id", "ts", "event")
    return watched.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp, accepted boolean", "began long", "append", GroupStateTimeout.EventTimeTimeout)
