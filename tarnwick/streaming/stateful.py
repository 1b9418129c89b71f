"""Interactions with users' interests and tag weights as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwick.config import InterestConfig
from tarnwick.operators.interests import UserFold

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which lists and maps need; the session's setting is as before after it."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


CENTRE = "coi_id string, point array<double>, view_count long, view_time_ms long, last_view timestamp"
#: What a micro-batch changes, by kind: all centres of its users (centre), the tag weights that changed (tag), the snippets
#: interacted with (log), and the time of the last interaction (seen).
UPDATES = f"user_id string, kind string, {CENTRE}, tag string, weight long, document_id string, sub_id long, time_stamp timestamp"
CENTRE_COLUMNS = [c.split()[0] for c in CENTRE.split(", ")]
TAG = "tag string, weight long"
#: In the state, and in rows on their way to and from Python, vectors are the bytes of their doubles and times microseconds.
_plain = lambda ddl: ddl.replace("array<double>", "binary").replace("timestamp", "long")
MADE = Row(*[c.split()[0] for c in UPDATES.split(", ")])


def packed(vectors: Column) -> Column:
    @F.pandas_udf("binary")
    def run(each: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, np.float64).tobytes() for v in each], dtype=object)

    return run(vectors)


def unpacked(vectors: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(each: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.frombuffer(v) for v in each], dtype=object)

    return run(vectors)


def _nulls_last(*values) -> tuple:
    return tuple((v is None, v if v is not None else 0) for v in values)


class Interactions(StatefulProcessor):
    """One user's state: a list of centres and a list of tag weights, each read and written by one call however many it has."""

    def __init__(self, config: InterestConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centres = handle.getListState("centres", _plain(CENTRE))
        self.tags = handle.getListState("tags", TAG)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        if initialState["kind"] == "centre":
            self.centres.appendValue(tuple(initialState[c] for c in CENTRE_COLUMNS))
        else:
            self.tags.appendValue((initialState["tag"], initialState["weight"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted(rows, key=lambda r: _nulls_last(r["time_stamp"], r["event_id"]))
        known = [r for r in events if r["embedding"] is not None]
        user = str(key[0])
        blank = dict.fromkeys(MADE)
        made = lambda kind, **what: MADE(*(blank | {"user_id": user, "kind": kind} | what).values())
        if known:
            yield from self._fold(user, known, made)
            yield from self._add_tags(known, made)
        for d, s, t in dict.fromkeys((r["document_id"], r["sub_id"], r["time_stamp"]) for r in known):
            yield made("log", document_id=d, sub_id=s, time_stamp=t)
        yield made("seen", time_stamp=max((r["time_stamp"] for r in events if r["time_stamp"] is not None), default=None))

    def _fold(self, user: str, known: list[Row], made) -> Iterator[Row]:
        now = UserFold(user, self.config)
        kept = [dict(zip(CENTRE_COLUMNS, c, strict=True)) for c in self.centres.get()]
        for c in sorted(kept, key=lambda c: (*_nulls_last(c["last_view"]), c["coi_id"])):  # as interact() orders them
            now.append(np.frombuffer(c.pop("point")), c)
        for r in known:
            now.add(r["time_stamp"], np.frombuffer(r["embedding"]))
        after = [c | {"point": p.tobytes()} for c, p in zip(now.centres, now.points, strict=False)]
        self.centres.put([tuple(c[name] for name in CENTRE_COLUMNS) for c in after])
        for c in after:
            yield made("centre", **{name: c[name] for name in CENTRE_COLUMNS})

    def _add_tags(self, known: list[Row], made) -> Iterator[Row]:
        added: dict[str, int] = {}
        for r in known:
            for tag in r["tags"] or ():
                added[tag] = added.get(tag, 0) + 1
        if not added:
            return
        weights = dict(self.tags.get())
        for tag, n in added.items():
            weights[tag] = weights.get(tag, 0) + n
        self.tags.put(list(weights.items()))
        for tag in added:
            yield made("tag", tag=tag, weight=weights[tag])

    def close(self) -> None:
        pass


def updates(events: DataFrame, centres: DataFrame, tags: DataFrame, config: InterestConfig = InterestConfig()) -> DataFrame:  # noqa: B008
    """UPDATES of each micro-batch of events (user_id, document_id, sub_id, event_id, time_stamp, embedding, tags), a stream;
    embeddings are packed(). A null embedding is that of an unknown snippet, which counts for the last-seen time only. centres and
    tags: what users have before the first micro-batch. A user's events are folded by time and event inside a micro-batch."""
    none = lambda ddl: [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in _plain(ddl).split(", ")]
    micros = lambda name: F.unix_micros(name).alias(name)
    before = centres.select("user_id", F.lit("centre").alias("kind"), "coi_id", packed("point").alias("point"), "view_count", "view_time_ms", micros("last_view"), *none(TAG))
    before = before.unionByName(tags.select("user_id", F.lit("tag").alias("kind"), *none(CENTRE), "tag", "weight"))
    rows = events.select("user_id", "document_id", "sub_id", "event_id", micros("time_stamp"), "embedding", "tags")
    out = rows.groupBy("user_id").transformWithState(Interactions(config), _plain(UPDATES), "Update", "None", before.groupBy("user_id"))
    return out.withColumns({"point": unpacked("point"), **{n: F.timestamp_micros(n) for n in ("last_view", "time_stamp")}})
