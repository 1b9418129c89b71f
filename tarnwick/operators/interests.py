"""Centres of interest: their fold over interactions, ageing, relevance and the scores they give."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import MAX_INTERESTS_FOR_KNN, InterestConfig
from tarnwick.functions.values import bound, dot, moved

#: Rows of one user that meet the user's centres in one group.
ROWS_A_PART = 20_000

INTERESTS = "user_id string, coi_id string, step int, point array<double>, view_count long, view_time_ms long, last_view timestamp"


def new_centre(user: str, step: int, time) -> dict:
    name = hashlib.sha256(f"{user}|{step}".encode()).hexdigest()[:32]
    return {"coi_id": name, "step": step, "view_count": 1, "view_time_ms": 0, "last_view": time}


def fold(state: list[dict], events: Iterable[tuple], user: str, config: InterestConfig) -> list[dict]:
    """Centres after the events (time, vector), in order: the nearest centre moves if it is near enough (the first of
    equally near ones), else the vector begins a centre of its own."""
    for time, vector in events:
        e = np.asarray(vector, np.float64)
        sims = np.clip(np.array([c["point"] for c in state]) @ e, -1.0, 1.0) if state else np.empty(0)
        i = int(sims.argmax()) if len(sims) else -1
        if i >= 0 and sims[i] >= config.threshold:
            c = state[i]
            p = c["point"] * (1 - config.shift) + e * config.shift
            n = np.sqrt(p @ p)
            c["point"] = p / n if n > 0 else p
            c["view_count"] += 1
            c["last_view"] = time
        else:
            state.append(new_centre(user, len(state), time) | {"point": e})
    return state


def log_view_time(state: list[dict], vector, milliseconds: int) -> None:
    """Adds the time to the nearest centre, if there is one."""
    if state:
        sims = np.array([c["point"] for c in state]) @ np.asarray(vector, np.float64)
        state[int(sims.argmax())]["view_time_ms"] += milliseconds


def state_frame(user: str, state: list[dict]) -> pd.DataFrame:
    rows = [{"user_id": user} | c | {"point": c["point"].tolist()} for c in state]
    return pd.DataFrame(rows, columns=["user_id", "coi_id", "step", "point", "view_count", "view_time_ms", "last_view"])


class UserFold:
    """One user's fold as rows arrive: centres in a growing matrix."""

    def __init__(self, user: str, config: InterestConfig):
        self.user, self.config, self.points, self.centres = user, config, np.empty((0, 0)), []

    def add(self, time, e: np.ndarray) -> None:
        n = len(self.centres)
        if n:
            sims = np.clip(self.points[:n] @ e, -1.0, 1.0)
            i = int(sims.argmax())
            if sims[i] >= self.config.threshold:
                p = self.points[i] * (1 - self.config.shift) + e * self.config.shift
                size = np.sqrt(p @ p)
                self.points[i] = p / size if size > 0 else p
                self.centres[i]["view_count"] += 1
                self.centres[i]["last_view"] = time
                return
        self.append(e, new_centre(self.user, n, time))

    def append(self, e: np.ndarray, centre: dict) -> None:
        n = len(self.centres)
        if n == len(self.points):
            grown = np.empty((max(8, 2 * n), len(e)))
            grown[:n] = self.points[:n] if n else grown[:0]
            self.points = grown
        self.points[n] = e
        self.centres.append(centre)

    def frame(self) -> pd.DataFrame:
        return state_frame(self.user, [c | {"point": p} for c, p in zip(self.centres, self.points, strict=False)])


#: What a centre from before the events brings, beside its user, time and point.
BEFORE = {"step": "int", "coi_id": "string", "view_count": "long", "view_time_ms": "long"}


def fold_interactions(events: DataFrame, config: InterestConfig = InterestConfig(), prior: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Centres of every user after all events (user_id, time_stamp, event_id, embedding), in order of time and event.

    Events are dealt by user and sorted, and each task folds them as they stream past: it holds one user's centres,
    never a user's events. prior: centres from before, which go ahead of their user's events.
    """
    none = [F.lit(None).cast(t).alias(n) for n, t in BEFORE.items()]
    rows = events.select("user_id", "time_stamp", "event_id", F.col("embedding").cast("array<double>").alias("e"), *none)
    if prior is not None:
        no_event = F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id")
        rows = rows.unionByName(prior.select("user_id", F.col("last_view").alias("time_stamp"), no_event, F.col("point").alias("e"), *[F.col(n).cast(t) for n, t in BEFORE.items()]))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: UserFold | None = None
        for pdf in batches:
            done = []
            vectors = np.array(pdf["e"].tolist(), np.float64)
            for user, time, e, coi_id, views, ms in zip(pdf["user_id"], pdf["time_stamp"], vectors, pdf["coi_id"], pdf["view_count"], pdf["view_time_ms"], strict=True):
                if now is None or user != now.user:
                    if now is not None:
                        done.append(now.frame())
                    now = UserFold(user, config)
                if isinstance(coi_id, str):
                    now.append(e, {"coi_id": coi_id, "step": len(now.centres), "view_count": int(views), "view_time_ms": int(ms), "last_view": time})
                else:
                    now.add(time, e)
            if done:
                yield pd.concat(done)
        if now is not None:
            yield now.frame()

    order = ["user_id", F.col("step").asc_nulls_last(), "time_stamp", "event_id"]
    return rows.repartition("user_id").sortWithinPartitions(*order).mapInPandas(stream, INTERESTS)


def fold_column(events: Column, config: InterestConfig = InterestConfig()) -> Column:  # noqa: B008
    """The same fold over an ordered array of structs (t, e), as one expression: an array of (point, n, last)."""

    def step(state: Column, x: Column) -> Column:
        def after(best: Column) -> Column:
            hit = F.transform(state, lambda c, i: F.when(i + 1 == best["at"], F.struct(moved(c["point"], x["e"], config.shift).alias("point"), (c["n"] + 1).alias("n"), x["t"].alias("last"))).otherwise(c))
            return F.when((F.size(state) > 0) & (best["of"] >= config.threshold), hit).otherwise(new)

        new = F.concat(state, F.array(F.struct(x["e"].alias("point"), F.lit(1).cast("long").alias("n"), x["t"].alias("last"))))
        nearest = lambda sims: F.struct(F.array_max(sims).alias("of"), F.array_position(sims, F.array_max(sims)).alias("at"))
        return bound(F.transform(state, lambda c: dot(c["point"], x["e"])), lambda sims: bound(nearest(sims), after))

    empty = F.array().cast("array<struct<point:array<double>,n:bigint,last:timestamp>>")
    return F.aggregate(events, empty, step)


def decay(last_view: Column, now: Column, horizon_days: int = 30) -> Column:
    """1 for a view just now or in the future, falling to 0 at the horizon; 0 if the horizon is 0 days."""
    if horizon_days == 0:
        return F.lit(0.0)
    days = (F.unix_micros(now) - F.unix_micros(last_view)) / F.lit(86_400_000_000.0)
    low = F.exp(F.lit(-0.1 * horizon_days))
    falling = (low - F.exp(-0.1 * days)) / (low - 1)
    return F.when(last_view > now, F.lit(1.0)).otherwise(F.greatest(falling, F.lit(0.0)))


def relevance(interests: DataFrame, now: Column, horizon_days: int = 30) -> DataFrame:
    """plus decay and relevance = (share of views + share of view time) * decay, shares among the user's centres."""
    w = Window.partitionBy("user_id")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1))
    out = interests.withColumn("decay", decay(F.col("last_view"), now, horizon_days))
    return out.withColumn("relevance", (share("view_count") + share("view_time_ms")) * F.col("decay"))


def weights(relevant: DataFrame) -> DataFrame:
    """plus weight = (1 - exp(-3 relevance)) over its sum among the user's centres; equal weights if that is 0."""
    w = Window.partitionBy("user_id")
    raw = 1 - F.exp(-3 * F.col("relevance"))
    out = relevant.withColumn("raw", raw)
    total = F.sum("raw").over(w)
    weight = F.when(total > 0, F.col("raw") / total).otherwise(1 / F.count(F.lit(1)).over(w))
    return out.withColumn("weight", weight).drop("raw")


def top_interests(weighted: DataFrame, most: int = MAX_INTERESTS_FOR_KNN) -> DataFrame:
    """Each user's centres of largest weight (ties: larger coi_id), their weights made to sum to 1."""
    w = Window.partitionBy("user_id").orderBy(F.col("weight").desc(), F.col("coi_id").desc())
    out = weighted.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return out.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("user_id")))


def _dealt(rows: DataFrame, centres: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows and centres with a part: users with more than ROWS_A_PART rows are dealt over as many parts as they need, by
    a hash of the key, and their centres go to each part. Only such users are in the table of sizes."""
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_A_PART).select("user_id", F.ceil(F.col("n") / ROWS_A_PART).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(sizes, "user_id", "left").withColumn("part", F.pmod(F.xxhash64(*key), parts).cast("int"))
    right = centres.join(sizes, "user_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("parts"), right.drop("parts")


def interest_scores(pairs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(user_id, document_id, sub_id, score) for pairs (user_id, document_id, sub_id, embedding): of the user's centre
    nearest to the snippet (the first of equally near ones) (similarity * decay + relevance + 1) / 4. Users without a
    centre have no scores. Pairs are dealt by user and stream past the user's centres, which go ahead of them; a user has few
    centres, and one with many pairs is dealt over parts."""
    left, right = _dealt(pairs.select("user_id", "document_id", "sub_id", "embedding"), relevant.select("user_id", "step", "point", "decay", "relevance"), ["document_id", "sub_id"])
    key = ["user_id", "part"]
    none = lambda df, *names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    centres = right.select(*key, "step", *none(pairs, "document_id", "sub_id"), F.col("point").cast("array<double>").alias("vec"), F.lit(True).alias("centre"), "decay", "relevance")
    rows = left.select(*key, *none(relevant, "step"), "document_id", "sub_id", F.col("embedding").cast("array<double>").alias("vec"), F.lit(False).alias("centre"), *none(relevant, "decay", "relevance"))
    schema = pairs.select("user_id", "document_id", "sub_id").withColumn("score", F.lit(0.0)).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            users, parts, centre = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("user_id", "part", "centre"))
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(users), -1)
            decay, relevance = batch.column("decay").to_numpy(zero_copy_only=False), batch.column("relevance").to_numpy(zero_copy_only=False)
            scores, known = np.zeros(len(users)), np.zeros(len(users), bool)
            new = (users[1:] != users[:-1]) | (parts[1:] != parts[:-1]) | (centre[1:] != centre[:-1])
            starts = np.flatnonzero(np.r_[True, new.astype(bool)])
            for lo, hi in zip(starts, np.r_[starts[1:], len(users)], strict=True):
                if (users[lo], parts[lo]) != at:
                    at, held = (users[lo], parts[lo]), []
                if centre[lo]:
                    held.append((vectors[lo:hi], decay[lo:hi], relevance[lo:hi]))
                elif held:
                    if len(held) > 1:
                        held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                    points, d, r = held[0]
                    sims = np.clip(vectors[lo:hi] @ points.T, -1.0, 1.0)
                    best = sims.argmax(axis=1)
                    scores[lo:hi] = (sims[np.arange(hi - lo), best] * d[best] + r[best] + 1) / 4
                    known[lo:hi] = True
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("user_id", "document_id", "sub_id")], pa.array(scores)], names=["user_id", "document_id", "sub_id", "score"])
            yield out.filter(pa.array(known))

    order = [*key, F.col("centre").desc(), "step"]
    return centres.unionByName(rows).repartition(*key).sortWithinPartitions(*order).mapInArrow(stream, schema)


def view_times(views: DataFrame, interests: DataFrame) -> DataFrame:
    """interests with the milliseconds of views (user_id, embedding, view_ms) added to the user's nearest centre."""
    added = "user_id string, coi_id string, added long"

    def run(v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(c):
            return pd.DataFrame(columns=["user_id", "coi_id", "added"])
        c = c.sort_values("step")
        sims = np.array(v["embedding"].tolist(), np.float64) @ np.array(c["point"].tolist(), np.float64).T
        sums = np.bincount(sims.argmax(axis=1), weights=v["view_ms"].to_numpy(np.float64), minlength=len(c))
        return pd.DataFrame({"user_id": c["user_id"].to_numpy(), "coi_id": c["coi_id"].to_numpy(), "added": sums.astype(np.int64)})

    left, right = _dealt(views.select("user_id", "embedding", "view_ms"), interests.select("user_id", "coi_id", "step", "point"), ["embedding", "view_ms"])
    per = left.groupBy("user_id", "part").cogroup(right.groupBy("user_id", "part")).applyInPandas(run, added)
    per = per.groupBy("user_id", "coi_id").agg(F.sum("added").alias("added"))
    out = interests.join(per, ["user_id", "coi_id"], "left").withColumn("view_time_ms", F.col("view_time_ms") + F.coalesce("added", F.lit(0)))
    return out.select(*interests.columns)
