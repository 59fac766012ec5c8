"""The sliding request limit over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placeloom.operators.balancing import RATE_LIMIT, WINDOW_S


def windowed_requests(events: DataFrame, window_s: int = WINDOW_S, slide_s: int = 10, late: str = "2 minutes") -> DataFrame:
    """client, start, end, requests: how many requests each client made in each sliding window, with late events admitted."""
    w = F.window("ts", f"{window_s} seconds", f"{slide_s} seconds")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "client").agg(F.count("*").alias("requests")).select("client", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def admitted(events: DataFrame, limit: int = RATE_LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """client, event_id, ts, available for each event of a stream: the state of a client is its last `limit` admitted times."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for g in frames:
            g = g.sort_values(["ts", "event_id"])
            out = []
            for t in g.ts.astype("int64") // 1000:
                free = len(times) < limit or t - times[0] >= window_s * 1_000_000
                out.append(free)
                if free:
                    times = (times + [int(t)])[-limit:]
            yield pd.DataFrame({"client": g.client, "event_id": g.event_id, "ts": g.ts, "available": out})
        state.update((times,))

    return events.select("client", "event_id", "ts").groupBy("client").applyInPandasWithState(run, "client string, event_id long, ts timestamp, available boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)
