"""Streaming queries, replayed over the driver's events; where windows close, they equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from windgrid.plans.base import query, read
from windgrid.plans.sources import _folder
from windgrid.streaming import live as L


def _events(spark, d, name):
    """Events as a folder of files to stream from, and a folder for the output."""
    at = _folder(spark, name)
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.expr("cast(event_id * 31 % 15000 as double)").alias("alt"))
    # one marker far ahead in time closes every window that holds rows
    end = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(0.0).alias("alt"))
    e.coalesce(1).write.parquet(f"{at}/in/part=0")
    end.coalesce(1).write.parquet(f"{at}/in/part=1")
    return f"{at}/in", f"{at}/out"


@query("str_01_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def str_01(spark, d):
    src, out = _events(spark, d, "windows")
    w = L.replay(spark, src, lambda s: L.windowed(s, "ts", ["event_type"], "1 hour", late="60 days"), out).where("event_type <> 'end'")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("str_02_deduplicated", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY 1")
def str_02(spark, d):
    src, out = _events(spark, d, "dedup")
    u = L.replay(spark, src, lambda s: L.deduplicated(s.unionByName(s), "ts", ["event_id"], "60 days").select("user_id", "event_id"), out)
    return u.where("event_id >= 0").groupBy("user_id").agg(F.count("*").alias("n"))


@query("str_03_sessions", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pt FROM events), f AS (SELECT *, CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) >= 21600000000 THEN 1 ELSE 0 END AS s FROM p), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def str_03(spark, d):
    src, out = _events(spark, d, "sessions")
    s = L.replay(spark, src, lambda s: L.sessions(s, "ts", ["user_id"], "6 hours", "60 days"), out).where("user_id >= 0")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("str_04_live_legs", "WITH p AS (SELECT user_id, event_id, ts, (event_id * 31 % 15000)::DOUBLE AS alt, lag(ts) OVER w AS pt, lag((event_id * 31 % 15000)::DOUBLE) OVER w AS pa FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, CASE WHEN pt IS NULL OR (epoch_us(ts) - epoch_us(pt)) / 1e6 > 21600 OR abs(alt - pa) > 5000 THEN 1 ELSE 0 END AS s FROM p) SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS leg, false AS late FROM f")
def str_04(spark, d):
    src, out = _events(spark, d, "legs")
    return L.replay(spark, src, lambda s: L.legs(s, "user_id", "ts", 21600.0, 5000.0), out).where("user_id >= 0")


@query("str_05_previous_frame", "WITH g AS (SELECT user_id AS tile, epoch_us(date_trunc('day', ts)) // 86400000000 AS frame, round(sum(value), 6) AS value FROM events GROUP BY 1, 2), l AS (SELECT *, lag(frame) OVER w AS pf, lag(value) OVER w AS pv FROM g WINDOW w AS (PARTITION BY tile ORDER BY frame)) SELECT frame, tile, value, CASE WHEN frame - pf <= 2 THEN pv END AS before FROM l")
def str_05(spark, d):
    at = _folder(spark, "frames")
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("tile"), F.expr("unix_micros(cast(date_trunc('day', ts) as timestamp)) div 86400000000").alias("frame")).agg(F.round(F.sum("value"), 6).alias("value"))
    e.write.parquet(f"{at}/in")
    return L.replay(spark, f"{at}/in", lambda s: L.previous_frame(s, 2), f"{at}/out")
