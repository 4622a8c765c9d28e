"""Event streams: windows with late data, running counts, duplicates and a review state machine.

Every function takes a batch or a streaming DataFrame of (event_id, ts, user_id, event_type, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet event files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSON-lines log; a line that isn't JSON is null in every column and left out."""
    return spark.readStream.schema(SCHEMA).option("mode", "PERMISSIVE").json(path).where(F.col("event_id").isNotNull())


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per window and kind; late is how long a stream waits for late events."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("begins"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begins"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("begins"), "n")


def without_repeats(events: DataFrame, late: str) -> DataFrame:
    """A stream without events that come again within the time that late events are waited for."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: state: {event: next state}; any other event leaves the state.
MOVES = {
    "idle": {"view": "awaiting_review"},
    "awaiting_review": {"click": "awaiting_confirmation", "error": "stopped"},
    "awaiting_confirmation": {"purchase": "idle", "error": "stopped", "view": "awaiting_review"},
    "stopped": {"signup": "idle"},
}


def moved(state: str, event: str) -> str:
    return MOVES[state].get(event, state)


def review_states(events: DataFrame) -> DataFrame:
    """The state of each user after each micro-batch, kept between batches by the engine."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, seen = held.get if held.exists else ("idle", 0)
        for batch in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            state, seen = moved(state, batch.event_type), seen + 1
        held.update((state, seen))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "events": [seen]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, state string, events long", "state string, seen long", "update", GroupStateTimeout.NoTimeout
    )


def review_states_batch(events: DataFrame) -> DataFrame:
    """The same for a whole table, inside the JVM: each user's hour of events is folded to where it leads from every state,
    and a user's hours are chained. So no row holds all events of a user."""
    hours = events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))

    def step(state, e):
        out = state
        for old, moves in MOVES.items():
            for event, new in moves.items():
                out = F.when((state == old) & (e["event_type"] == event), new).otherwise(out)
        return out

    def chained(state, hour):
        out = state
        for old in MOVES:
            out = F.when(state == old, hour[f"from_{old}"]).otherwise(out)
        return out

    led = hours.select("user_id", "hour", F.size("e").cast("long").alias("n"), *[F.aggregate("e", F.lit(old), step).alias(f"from_{old}") for old in MOVES])
    users = led.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("hour", *[f"from_{old}" for old in MOVES]))).alias("hours"), F.sum("n").alias("events"))
    return users.select("user_id", F.aggregate("hours", F.lit("idle"), chained).alias("state"), "events")
