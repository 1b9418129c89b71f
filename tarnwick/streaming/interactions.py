"""Interactions as a stream: per-user interests and last-seen times."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.config import InterestConfig
from tarnwick.operators.interests import INTERESTS, fold, state_frame


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events (event_id, time_stamp, ...) once each; repeats that come later than the delay are dropped as late."""
    return events.withWatermark("time_stamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def interest_updates(events: DataFrame, config: InterestConfig = InterestConfig()) -> DataFrame:  # noqa: B008
    """Of each micro-batch the centres of all users with new events (user_id, time_stamp, event_id, embedding).

    A user's events are folded in the order of time and event inside a micro-batch, and in order of arrival across
    micro-batches, as a late event finds the state that others have moved already.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centres = pickle.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["time_stamp", "event_id"])
        centres = fold(centres, zip(pdf["time_stamp"], pdf["embedding"], strict=True), key[0], config)
        state.update((pickle.dumps(centres),))
        yield state_frame(key[0], centres)

    slim = events.select("user_id", "time_stamp", "event_id", "embedding")
    return slim.groupBy("user_id").applyInPandasWithState(run, INTERESTS, "centres binary", "update", GroupStateTimeout.NoTimeout)


def last_seen_updates(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("time_stamp").alias("last_seen"))


def latest_state(updates: DataFrame) -> DataFrame:
    """Of all emitted centres (with ``batch``, the micro-batch's number) each user's last ones."""
    last = updates.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["user_id", "batch"]).drop("batch")
