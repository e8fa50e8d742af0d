"""Tracks: leg summaries, edges between legs, paths, quality."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.functions import geo
from windgrid.operators.joins import successors
from windgrid.operators.ordering import top_k



def order():
    """Time, then row: the order within a track."""
    return F.struct("us", "event_id")


def tier(n: str = "n"):
    return F.when(F.col(n) >= 8, "T0").when(F.col(n) >= 3, "T1").when(F.col(n) == 2, "T2").otherwise("T3")


def tracklets(legs: DataFrame) -> DataFrame:
    """One row per leg: size, times, way, top, tier. A break's own step does not count into the new leg."""
    way = F.sum(F.when(F.col("brk"), 0.0).otherwise(F.col("km")))
    g = legs.groupBy("ident", "leg").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.round(way, 3).alias("km"), F.max("alt").alias("top"))
    return g.withColumn("tier", tier())


def leg_ends(legs: DataFrame) -> DataFrame:
    """First and last position of each leg."""
    ends = [f(c, order()).alias(f"{p}_{c}") for p, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon", "alt", "us")]
    return legs.groupBy("ident", "leg").agg(F.count("*").alias("n"), *ends)


def edges(ends: DataFrame, most_gap_s: float, gate: float, lags: int = 3) -> DataFrame:
    """Candidate links of a leg to its next `lags` legs: distances, scaled residuals, prior, and whether it is physical."""
    e = ends.withColumn("a", F.col("start_us") / 1e6).withColumn("b", F.col("end_us") / 1e6)
    e = successors(e, ["ident"], ["a", "leg"], ["leg", "a", "start_lat", "start_lon", "start_alt"], lags, most_gap_s, "a", "b")
    km = geo.haversine_km(F.col("end_lat"), F.col("end_lon"), F.col("to_start_lat"), F.col("to_start_lon"))
    e = e.withColumn("km", km).withColumn("speed", F.col("km") * 1000 / F.col("gap")).withColumn("climb", F.abs(F.col("to_start_alt") - F.col("end_alt")))
    m, alt = F.col("km") / (3 + 0.03 * F.col("gap")), F.col("climb") / (500 + 3 * F.col("gap"))
    e = e.withColumn("m", m).withColumn("malt", alt)
    e = e.withColumn("prior", F.exp(-0.55 * F.col("m") - 0.35 * F.col("malt") - 0.004 * F.col("speed") - 0.001 * F.col("gap") / 60))
    return e.withColumn("physical", (F.col("m") <= gate) & (F.col("malt") <= gate) & (F.col("speed") <= 420))


def paths(ends: DataFrame, linked: DataFrame, k: int) -> DataFrame:
    """Every leg alone, and stitched to its k best physical successors: first_leg, second_leg (null), score."""
    single = ends.select("ident", F.col("leg").alias("first_leg"), F.lit(None).cast("long").alias("second_leg"), F.lit(1.0).alias("score"))
    best = top_k(linked.where("physical"), ["ident", "leg"], [F.col("prior").desc(), "to_leg"], k)
    return single.unionByName(best.select("ident", F.col("leg").alias("first_leg"), F.col("to_leg").alias("second_leg"), F.col("prior").alias("score")))


@dataclass(frozen=True)
class LegRules:
    """What a leg may have, in seconds, km, m and m/s."""

    least_points: int = 5
    least_s: float = 180.0
    hard_gap_s: float = 900.0
    warn_gap_s: float = 300.0
    jump_km: float = 100.0
    most_speed: float = 340.0
    most_climb: float = 75.0
    level_range_m: float = 1800.0
    dense_s: tuple[float, float] = (90.0, 180.0)
    fast: tuple[float, float] = (280.0, 320.0)
    strong: tuple[int, float, float] = (20, 600.0, 20.0)
    broad: tuple[int, float, float] = (10, 300.0, 10.0)
    broad_gap_s: float = 120.0


def quality(legs: DataFrame, rules: LegRules = LegRules()) -> DataFrame:
    """Nine failure flags, five grades, the overall grade and the readiness of every leg.

    legs: ident, leg, us, alt, prev_alt, dt, km, brk and tail, flight (null: missing). Steps over a break do not count.
    Quantiles are within a leg, which is bounded by how long an aircraft flies.
    """
    r, inside = rules, ~F.col("brk")
    step, gap = F.when(inside, F.col("alt") - F.col("prev_alt")), F.when(inside, F.col("dt"))
    speed = F.try_divide(F.when(inside, F.col("km") * 1000), gap)
    g = legs.groupBy("ident", "leg").agg(
        F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"), F.coalesce(F.sum(F.when(inside, F.col("km"))), F.lit(0.0)).alias("km"), (F.max_by("alt", F.struct("us", "event_id")) - F.min_by("alt", F.struct("us", "event_id"))).alias("change"), (F.max("alt") - F.min("alt")).alias("range"),
        F.count_if(gap <= 0).alias("back"), F.count_if(speed > r.most_speed).alias("fast"), F.count_if(F.when(inside, F.col("km")) > r.jump_km).alias("jumps"), F.count_if(gap > r.warn_gap_s).alias("gaps"), F.count_if(F.try_divide(F.abs(step), gap) > r.most_climb).alias("steep"),
        F.count_if(F.col("tail").isNull() & F.col("flight").isNull()).alias("unnamed"), F.max(F.col("tail").isNotNull().cast("int")).alias("has_tail"), F.max(F.col("flight").isNotNull().cast("int")).alias("has_flight"),
        F.count_if(step > 50).alias("up"), F.count_if(step < -50).alias("down"), F.percentile(gap, 0.9).alias("gap_q90"), F.coalesce(F.max(gap), F.lit(0.0)).alias("gap_max"), F.percentile(speed, 0.99).alias("speed_q99"),
    )
    edges = F.greatest(F.col("n") - 1, F.lit(1))
    phase = F.when(F.col("change") > 500, "ASC").when(F.col("change") < -500, "DES").otherwise("LVR")
    g = g.withColumns({"phase": phase, "fast_ratio": F.col("fast") / edges, "gap_q": F.coalesce("gap_q90", F.lit(999_999.0)), "speed_q": F.coalesce("speed_q99", F.lit(0.0))})
    mixed = ((F.col("phase") == "ASC") & (F.col("down") / edges > 0.35)) | ((F.col("phase") == "DES") & (F.col("up") / edges > 0.35)) | ((F.col("phase") == "LVR") & (F.col("range") > r.level_range_m))
    flags = {"time_order": F.col("back") > 0, "speed": F.col("fast") > 0, "jump": F.col("jumps") > 0, "gap": F.col("gaps") > 0, "altitude": F.col("steep") > 0, "identity": F.col("unnamed") > 0, "duration": F.col("seconds") < r.least_s, "points": F.col("n") < r.least_points, "phase_mixed": mixed}
    g = g.withColumns({f"failed_{n}": c for n, c in flags.items()})
    failed = lambda *names: reduce(lambda a, b: a | b, [F.col(f"failed_{n}") for n in names])
    near, far = r.dense_s
    slow, quick = r.fast
    named = F.col("has_tail") + F.col("has_flight")
    dense = (F.col("n") >= r.strong[0]) & (F.col("seconds") >= r.strong[1]) & (F.col("gap_q") <= near)
    grades = {
        "time": F.when(failed("time_order") | (F.col("gap_max") > r.hard_gap_s), 1).when((F.col("gap_q") <= near) & (F.col("gap_max") <= far), 3).when((F.col("gap_q") <= far) & (F.col("gap_max") <= r.warn_gap_s), 2).otherwise(1),
        "geometry": F.when(failed("jump") | (F.col("fast_ratio") > 0.02), 1).when((F.col("fast") == 0) & (F.col("speed_q") <= slow), 3).when(F.col("speed_q") <= quick, 2).otherwise(1),
        "identity": F.when(named == 2, 3).when(named == 1, 2).otherwise(1),
        "sampling": F.when(dense, 3).when((F.col("n") >= r.least_points) & (F.col("seconds") >= r.least_s) & (F.col("gap_q") <= far), 2).otherwise(1),
        "phase": F.when(failed("phase_mixed"), 1).when((F.col("phase") == "LVR") & (F.col("range") > 1000), 2).otherwise(3),
    }
    g = g.withColumns({f"{n}_score": c for n, c in grades.items()}).withColumn("score", F.least(*[F.col(f"{n}_score") for n in grades]))
    hard = failed("time_order", "altitude", "identity", "points", "duration", "jump", "phase_mixed") | (F.col("fast_ratio") > 0.02)
    g = g.withColumns({"hard": hard, "failures": sum((F.col(f"failed_{n}").cast("int") for n in flags), F.lit(0)), "grade": F.when(hard | (F.col("score") < 2), "C").when(F.col("score") >= 3, "A").otherwise("B")})
    fits = lambda size, q, most: (F.col("n") >= size[0]) & (F.col("seconds") >= size[1]) & (F.col("km") >= size[2]) & (F.col("gap_q") <= q) & (F.coalesce("speed_q99", F.lit(999_999.0)) <= most)
    good = F.col("grade") != "C"
    return g.withColumn("ready", F.when(good & fits(r.strong, near, slow), "M1_strong").when(good & fits(r.broad, r.broad_gap_s, quick), "M2_broad").otherwise("M3_not_ready"))


def previous_within(df: DataFrame, keys: list[str], order: list, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def pseudo_batches(points: DataFrame, keys: list[str], order: list[str], sizes: tuple[int, ...], least: int = 20, delay_us: int = 60_000_000) -> DataFrame:
    """Legs of `least` points or more cut into whole batches of each size, as if received `delay_us` after their last point."""
    w = Window.partitionBy(*keys)
    r = points.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)}).where(F.col("__n") >= least)
    r = r.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("batch", F.floor(F.col("__i") / F.col("size")))
    g = r.groupBy(*keys, "size", "batch").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), (F.max("us") + delay_us).alias("end_us"), F.min("event_id").alias("first_event"))
    return g.where("n = size")
