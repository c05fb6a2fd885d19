"""Message validation and supersession on Structured Streaming frames. The rules are the batch ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkfold.plans.verify_queries import valid_message


def validated(messages: DataFrame) -> DataFrame:
    """Each message with is_valid; stateless, so it runs on batch and streaming frames alike."""
    return messages.withColumn("is_valid", F.coalesce(valid_message(), F.lit(False)))


def superseding(messages: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """session, window, request_id of the newest render request of each session within each window of event time; use
    update output. A request supersedes those of its window, and a window's state goes once the watermark passes it."""
    asked = messages.where("type = 'RENDER_PAGE'").withWatermark("ts", watermark)
    return asked.groupBy("session", F.window("ts", window).alias("window")).agg(F.max("request_id").alias("request_id"), F.count("*").alias("requests"))


def render_sessions(messages: DataFrame, watermark: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """session, request_id, verdict: a renderer answers only between its open and its close. The state of
    a session is one word; messages of one batch are taken in order of request_id. A session that the watermark
    leaves ``idle_ms`` behind is forgotten, and not open if it comes back."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else "not_open"
        rows, latest = [], state.getCurrentWatermarkMs()
        for m in pd.concat(list(batches)).sort_values("request_id").itertuples():
            latest = max(latest, int(m.ts.timestamp() * 1000))
            if m.type == "OPEN_RENDERER":
                verdict = "opened" if now == "not_open" else "invalid_request"
                now = "open" if now == "not_open" else now
            elif m.type == "CLOSE_RENDERER":
                now = verdict = "closed"
            elif now != "open":
                verdict = now
            else:
                verdict = "accepted" if m.is_valid else "invalid_request"
            rows.append((key[0], m.request_id, verdict))
        state.update((now,))
        state.setTimeoutTimestamp(latest + idle_ms)
        yield pd.DataFrame(rows, columns=["session", "request_id", "verdict"])

    return (
        validated(messages).withWatermark("ts", watermark).select("session", "request_id", "ts", "type", "is_valid").groupBy("session")
        .applyInPandasWithState(step, "session long, request_id long, verdict string", "now string", "append", GroupStateTimeout.EventTimeTimeout)
    )
