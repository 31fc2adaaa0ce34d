"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUNDS = "user_id long, event_id long, round long, silent boolean"


def counted_rounds(events: DataFrame, cap: int = 3, up: str = "error", reset: str = "purchase") -> DataFrame:
    """(user_id, event_id, round, silent): the batch counter with reset, kept as keyed state of a count and a flag.

    Events of one trigger are taken in order of (ts, event_id); the source must not
    deliver a user's events out of order across triggers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, silent = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, kind in zip(rows.event_id, rows.event_type, strict=True):
            n = 0 if kind == reset else n + (kind == up)
            silent = silent or n > cap
            out.append((key[0], event, min(n, cap), silent))
        state.update((n, silent))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "round", "silent"])

    return events.groupBy("user_id").applyInPandasWithState(step, ROUNDS, "n long, silent boolean", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; windows close when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select("w.start", "event_type", "events")


def indexed(files: DataFrame, target: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Index files as they arrive: the facts of each batch are written under its number.

    A batch that is retried after a failure overwrites its own folder only, so
    facts are there exactly once; readers take the last batch of each path.
    """

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
