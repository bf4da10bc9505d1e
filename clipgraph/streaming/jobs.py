"""Continuous forms of clip windows, duplicate suppression and static ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clipgraph.session import checkpoint_dir


def clip_window_counts(stream: DataFrame, ts: str, keys: list[str], length: str, stride: str, late: str) -> DataFrame:
    """Rows per key and sliding event-time window, emitted once the watermark has passed the window."""
    win = F.window(F.col(ts), length, stride)
    out = stream.withWatermark(ts, late).groupBy(*keys, win.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def static_ranges(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of static clips per key: sessions without a pause of ``gap``."""
    session = F.session_window(F.col(ts), gap)
    out = stream.withWatermark(ts, late).groupBy(*keys, session.alias("s")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
    return out.select(*keys, "first_ts", "last_ts", "n")


def settle_events(
    frames: np.ndarray, conf: np.ndarray, seq: np.ndarray, kept_before: np.ndarray, horizon: float, distance: int
) -> np.ndarray:
    """Decide buffered events: 1 kept, 0 dropped, -1 open.

    Everything up to frame ``horizon`` has arrived. An event is kept when it is the best open
    one within ``distance`` and no better one can still come; its neighbours are dropped.
    """
    state = np.full(len(frames), -1)
    kept, blocked = set(kept_before.tolist()), set()
    # in falling order no later decision touches an earlier one, and only the frames around an event are looked up
    for i in np.lexsort((seq, -conf)).tolist():
        f = int(frames[i])
        near = range(f - distance, f + distance + 1)
        if not kept.isdisjoint(near):
            state[i] = 0
        elif f + distance < horizon and blocked.isdisjoint(near):
            state[i] = 1
            kept.add(f)
        else:
            blocked.add(f)
    return state


def still_needed(kept: list[int], horizon: float, open_frames: list[int], distance: int) -> list[int]:
    """Kept frames that can still suppress an event: what is open or may come lies at the oldest open frame or the horizon."""
    oldest = min([horizon, *open_frames])
    return [int(k) for k in kept if k + distance >= oldest]


def suppress_duplicates(
    stream: DataFrame, keys: list[str], ts: str, frame_of_epoch: tuple[float, float], late: str, distance: int = 3
) -> DataFrame:
    """Suppression with state per key: an event goes out when the watermark rules out a better neighbour.

    ``stream`` has ``keys``, ``ts``, ``frame``, ``confidence`` and ``event_seq``.
    ``frame_of_epoch`` is (epoch second of frame 0, seconds per frame). The state holds the open
    events and the kept frames that can still suppress one, so it stays as short as the
    frames between the watermark and the newest event.
    """
    zero, per_frame = frame_of_epoch
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    out_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", event_seq bigint, frame int, confidence double"
    state_schema = "frames array<int>, conf array<double>, seq array<bigint>, kept array<int>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, conf, seq, kept = state.get if state.exists else ([], [], [], [])
        frames, conf, seq, kept = list(frames), list(conf), list(seq), list(kept)
        for b in batches:
            frames += b["frame"].tolist()
            conf += b["confidence"].tolist()
            seq += b["event_seq"].tolist()
        horizon = np.floor((state.getCurrentWatermarkMs() / 1000.0 - zero) / per_frame)
        f, c, s = np.array(frames, dtype=np.int64), np.array(conf), np.array(seq, dtype=np.int64)
        settled = settle_events(f, c, s, np.array(kept, dtype=np.int64), horizon, distance)
        go = settled == 1
        rest = settled == -1
        kept = still_needed([*kept, *f[go].tolist()], float(horizon), f[rest].tolist(), distance)
        if rest.any() or kept:
            state.update((f[rest].astype(int).tolist(), c[rest].tolist(), s[rest].tolist(), kept))
            # called again when the next open event can be decided, or when the last kept frame can suppress nothing more
            next_ = int(f[rest].min()) if rest.any() else max(kept) + distance
            wake = int((zero + (next_ + distance + 1) * per_frame) * 1000)
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if go.any():
            head = {k: [v] * int(go.sum()) for k, v in zip(keys, key)}
            yield pd.DataFrame({**head, "event_seq": s[go], "frame": f[go].astype(np.int32), "confidence": c[go]})

    marked = stream.withWatermark(ts, late)
    return marked.groupBy(*keys).applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process what the source has now, write it to the shared folder and read it back."""
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream with a TIMESTAMP event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
