"""Continuous forms: hourly means under a watermark, the last observation of each station, bursts, stale volumes. Each also runs on a static DataFrame where that has a meaning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.angles import bearing_from, east, north

#: How late an hourly cycle may come: an hour and what it takes to appear.
LATENESS, MEMORY = "135 minutes", "6 hours"


def hourly(obs: DataFrame, late: str = LATENESS) -> DataFrame:
    """Vector mean wind by station and hour (``begin``); an hour closes when the watermark has passed it, later rows are dropped."""
    src = obs.withWatermark("time", late) if obs.isStreaming else obs
    g = src.groupBy("station", F.window("time", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.avg(east("speed", "from_deg")).alias("e"), F.avg(north("speed", "from_deg")).alias("nn"))
    return g.select("station", F.col("w.start").alias("begin"), "n", "mean_speed", F.hypot("e", "nn").alias("vector_speed"), bearing_from("e", "nn").alias("from_deg"))


def bursts(obs: DataFrame, gap: str = "2 hours", late: str = LATENESS) -> DataFrame:
    """Sessions of a station's rows that are no further than ``gap`` apart."""
    src = obs.withWatermark("time", late) if obs.isStreaming else obs
    g = src.groupBy("station", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n"), F.max("time").alias("last"))
    return g.select("station", F.col("w.start").alias("begin"), "last", "n")


def last_values(obs: DataFrame, memory_ms: int = 6 * 3_600_000) -> DataFrame:
    """After each batch the newest row so far of every station that reported in it (the first of equal times stays); one that has been silent for ``memory_ms`` of event time is forgotten with ``expired``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            t, speed, way = state.get
            state.remove()
            yield pd.DataFrame({"station": [key[0]], "time": [pd.Timestamp(t, unit="us")], "speed": [speed], "from_deg": [way], "expired": [True]})
            return
        best = state.get if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("time", kind="stable")
            top = pdf[pdf["time"] == pdf["time"].max()].iloc[0]
            t = top["time"].value // 1000
            if best is None or t > best[0]:
                best = (t, float(top["speed"]), float(top["from_deg"]))
        if best is not None:
            state.update(best)
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(best[0] // 1000, mark) + memory_ms)
            yield pd.DataFrame({"station": [key[0]], "time": [pd.Timestamp(best[0], unit="us")], "speed": [best[1]], "from_deg": [best[2]], "expired": [False]})

    out = "station bigint, time timestamp, speed double, from_deg double, expired boolean"
    return obs.withWatermark("time", LATENESS).groupBy("station").applyInPandasWithState(step, out, "t bigint, speed double, way double", "update", GroupStateTimeout.EventTimeTimeout)


def fresh(volumes: DataFrame, now: str, keep_minutes: int = 135) -> DataFrame:
    """Volumes (``valid_time``) with ``stale``: past the time that they may be used for at ``now``."""
    return volumes.withColumn("stale", F.col("valid_time") + F.expr(f"interval {keep_minutes} minutes") < F.to_timestamp(F.lit(now)))


def once(df: DataFrame, key: list[str], late: str = LATENESS) -> DataFrame:
    """First row of each key within the watermark."""
    return df.withWatermark("time", late).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


#: Fixed value: cycles that may be walked back before there is none.
WALK_BACK = 6


def latest_cycle(obs: DataFrame, cycles: DataFrame, steps: int = WALK_BACK) -> DataFrame:
    """Observations (time) with the newest cycle there was at their time: ``cycle``, ``valid_time`` and ``code``.

    ``cycles`` has cycle (an hour), issued (when it could first be read) and valid_time (what its file says). Of the ``steps`` hours up to the observation's the newest
    issued by then is taken: an equi-join by hour, not a search. Refused: no-cycle (none of them was there), mismatched-time (its file is of another hour than its name).
    """
    c = F.col
    own = fresh_id(obs)
    asked = own.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_hour", F.date_trunc("hour", "time") - F.make_dt_interval(hours="_back"))
    there = cycles.select(c("cycle").alias("_hour"), "issued", "valid_time").dropDuplicates(["_hour"])
    met = asked.join(there, "_hour").where(c("issued") <= c("time"))
    best = met.groupBy("_id").agg(F.max_by(F.struct(c("_hour").alias("cycle"), "valid_time"), "_hour").alias("b"))
    j = own.join(best, "_id", "left")
    code = F.when(c("b").isNull(), "no-cycle").when(c("b.valid_time") != c("b.cycle"), "mismatched-time")
    return j.select(*[f"`{k}`" for k in obs.columns], "b.cycle", "b.valid_time", code.alias("code"))


def fresh_id(obs: DataFrame) -> DataFrame:
    """With ``_id``, a hash of the row: equal rows are one question."""
    return obs.withColumn("_id", F.xxhash64(*[f"`{c}`" for c in obs.columns])).dropDuplicates(["_id"])


def paired_with_cycles(obs: DataFrame, read_cycles, accepted: str, refused: str, steps: int = WALK_BACK):
    """A writer of a stream: each batch is joined with the cycles there are when it runs (``read_cycles`` is called anew), so that late cycles are found.

    Rows with a code go to ``refused``, others to ``accepted``, each batch into a folder of its own that a repeated batch replaces.
    """

    def batch(rows: DataFrame, k: int) -> None:
        got = latest_cycle(rows, read_cycles(), steps).persist()
        try:
            got.where("code is null").drop("code").write.mode("overwrite").parquet(f"{accepted}/batch={k}")
            got.where("code is not null").write.mode("overwrite").parquet(f"{refused}/batch={k}")
        finally:
            got.unpersist()

    return obs.writeStream.foreachBatch(batch)


def directory(answers: DataFrame, keep_ms: int = 24 * 3_600_000) -> DataFrame:
    """A directory that is asked again and again (key, time, listing; listing null: the request failed): what it would serve after each batch.

    listing, ``as_of`` (when it was last read), ``stale`` (the newest request failed and an older listing serves) and ``error`` (it failed and none is kept).
    A listing is forgotten once event time has passed it by ``keep_ms``. Late answers older than the kept one change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        listing, as_of, asked = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            for r in pdf.sort_values("time", kind="stable").itertuples():
                t = r.time.value // 1_000_000
                if r.listing is not None and (as_of is None or t >= as_of):
                    listing, as_of = r.listing, t
                asked = max(asked, t)
        if as_of is not None and asked - as_of > keep_ms:
            listing, as_of = None, None
        state.update((listing, as_of, asked))
        state.setTimeoutTimestamp(max(as_of or asked, state.getCurrentWatermarkMs()) + keep_ms)
        stamp = None if as_of is None else pd.Timestamp(as_of, unit="ms")
        yield pd.DataFrame({"key": [key[0]], "listing": [listing], "as_of": pd.Series([stamp], dtype="datetime64[ns]"), "stale": [as_of is not None and as_of < asked], "error": [as_of is None]})

    out = "key string, listing string, as_of timestamp, stale boolean, error boolean"
    return answers.withWatermark("time", LATENESS).groupBy("key").applyInPandasWithState(step, out, "listing string, as_of long, asked long", "update", GroupStateTimeout.EventTimeTimeout)
