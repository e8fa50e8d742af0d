"""Streams of observations: windows, duplicates, sessions, legs, previous frames.

Each function takes a streaming (or batch) DataFrame with an event-time column and returns one; sinks are
chosen by the caller. `replay` drives a bounded table through such a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from windgrid.runtime import ship

LATE = "10 minutes"


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and means per window; a row later than `late` behind the newest is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key, as long as the watermark remembers it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = LATE) -> DataFrame:
    """Runs without a gap in time; a gap of exactly `gap` ends a session."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(s.alias("s"), *keys).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def legs(stream: DataFrame, key: str, time: str, gap_s: float, climb_m: float) -> DataFrame:
    """Leg numbers by physical breaks (gap or jump in altitude), with the last point as state.

    Rows of one key in one micro-batch are ordered by time; a row older than the state opens no leg and is
    flagged as out of order.
    """
    ship(stream.sparkSession)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        leg, last, alt = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(parts)).sort_values([time, "event_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            t = getattr(r, time).timestamp()
            late = last is not None and t < last
            if not late:
                if last is None or t - last > gap_s or abs(r.alt - alt) > climb_m:
                    leg += 1
                last, alt = t, float(r.alt)
            out.append((k[0], int(r.event_id), leg, late))
        state.update((leg, last, alt))
        yield pd.DataFrame(out, columns=[key, "event_id", "leg", "late"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, leg long, late boolean", "leg long, last double, alt double", "append", GroupStateTimeout.NoTimeout)


def previous_frame(stream: DataFrame, most_gap: int) -> DataFrame:
    """frame, tile, value with the value of the frame before, if at most `most_gap` frames lie between.

    Frames that come out of order are answered from the state but do not replace a newer one.
    """
    ship(stream.sparkSession)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        frame, value = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(parts)).sort_values("frame", kind="stable").itertuples(index=False):
            near = frame is not None and 0 < r.frame - frame <= most_gap
            out.append((int(r.frame), int(k[0]), float(r.value), float(value) if near else None))
            if frame is None or r.frame > frame:
                frame, value = int(r.frame), float(r.value)
        state.update((frame, value))
        yield pd.DataFrame(out, columns=["frame", "tile", "value", "before"])

    return stream.groupBy("tile").applyInPandasWithState(step, "frame long, tile long, value double, before double", "frame long, value double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], out: str, mode: str = "append") -> DataFrame:
    """Runs transform over the Parquet files at path as a stream, into Parquet at out (append) or a table (complete).

    Its checkpoint lies beside the output, so that a run that is broken off goes on where it was.
    """
    schema = spark.read.parquet(path).schema
    stream = transform(spark.readStream.schema(schema).parquet(path))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True)
    q = q.format("parquet").option("path", f"{out}/data").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
